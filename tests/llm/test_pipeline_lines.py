"""What the line rules remove does not reach the later stages."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402


def test_failing_lines_are_gone(spark):
    good = ["This is a calm and ordinary sentence of ten words.", "Another line follows with some more words in it, here."]
    text = "\n".join([good[0], "Home | News | About", good[1], "Accept all cookies", "Yes.", "Yes."])
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, "").collect()
    clean = "\n".join([*good, "Yes."])
    assert [tuple(r) for r in got] == [(1, clean, "en", "s", len(clean))]
