"""Cross-parsing of whole texts against brute force: long texts, texts that never fall into step, rare and empty references."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language

WORDS = "ba ce di fo gu lan mer nix ops tur vel zim kor pal".split()


def cut(text, reference):
    """Phrases of the greedy parse, from the start of the text to its end."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in reference:
            n += 1
        at, count = at + max(n - 1, 1), count + 1
    return count


@pytest.mark.parametrize("run", [2048, 64, 3])
def test_whole_texts_are_one_parse(monkeypatch, run):
    monkeypatch.setattr(language, "RUN", run)
    rng = random.Random(run)
    ref = {k: " ".join(rng.choice(words) for _ in range(150)) for k, words in (("aa", WORDS[:7]), ("bb", WORDS[5:]), ("cc", ["a" * 5]))}
    ref["dd"], ref["ee"] = "", "qq"
    langs = language.build({k: [v] for k, v in ref.items()})
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 30, 300, 900)] + ["a" * 999, ("a" * 7 + "b") * 130, ref["aa"], ref["bb"] * 4, "漢" * 300, ""]
    got, literals = langs.counts(texts)
    assert got.tolist() == [[cut(t, ref[k]) for k in langs.names] for t in texts]
    assert literals.tolist() == [[sum(c not in ref[k] for c in t) for k in langs.names] for t in texts]


def test_a_very_long_text_is_one_parse():
    rng = random.Random(7)
    ref = " ".join(rng.choice(WORDS) for _ in range(300))
    text = " ".join(rng.choice(WORDS) for _ in range(32_000))[:100_000]
    assert language.build({"aa": [ref]}).phrases([text])[0, 0] == cut(text, ref)


def test_large_alphabets_and_tiny_references():
    rng = random.Random(2)
    said = {k: " ".join("".join(chr(first + rng.randrange(800)) for _ in range(4)) for _ in range(900)) for k, first in (("zh", 0x4E00), ("zz", 0x6000))}
    said["en"] = " ".join(rng.choice(WORDS) for _ in range(600))
    langs = language.build({k: [v] for k, v in said.items()} | {"no": [], "ok": ["ok"], "n2": ["12"]})
    for name, text in said.items():
        words = text.split()
        assert langs.predict([" ".join(rng.choice(words) for _ in range(20))])[0] == [name]


def test_passages_come_from_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "PASSAGE_CHARS", 10)
    # only the end of a long text has these letters, and only every passage's drawing finds them
    docs = spark.createDataFrame([(1, "a" * 95 + "xyzxyzxyz", "en"), (2, None, "en"), (3, "", "de"), (None, "b" * 12, "fr"), (6, "c" * 50, None)], "doc_id long, text string, lang string")
    langs = language.fit(docs.withColumn("n", F.lit(1)).withColumn("share", F.lit("x")))
    assert langs.names == [k for k in ("de", "en", "fr") if k in langs.names] and {"en", "de"} <= set(langs.names)
    assert langs.counts(["xyz"])[1][0].tolist()[langs.names.index("en")] == 0
