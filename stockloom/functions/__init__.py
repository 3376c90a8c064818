"""Column functions: folds over ordered arrays and accuracy measures."""
