"""The encoder's use of the machine."""

from __future__ import annotations

import os
import time

from stockloom.llm import tokenstore


def test_encoder_starts_no_threads_of_its_own(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    with open(tokenstore.default_tokenizer(), encoding="utf-8") as f:
        encoder = tokenstore.Encoder(f.read())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    texts = [f"word{k} other{k * 7} " * 200 for k in range(400)]
    whole, own = time.process_time(), time.thread_time()
    encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    whole, own = time.process_time() - whole, time.thread_time() - own
    assert whole < 1.5 * own + 0.1
