"""Cases that the operators define: sparse sites, compressed sizes, very long texts, clashing names, repeated ids."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cartulary.llm import ann, language_id, mixture, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sites_help_where_texts_say_little(spark):
    """Two thousand sites of four documents, half of them good throughout and half bad; the words tell little."""
    rng = random.Random(11)
    rows, labels = [], []
    for site in range(2_000):
        rate = 0.93 if site % 2 else 0.07
        for k in range(4):
            good = rng.random() < rate
            hint = rng.random() < (0.6 if good else 0.4)
            rows.append((4 * site + k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12)) + (" pro" if hint else " con"), "en", f"s{site}", 0))
            labels.append((4 * site + k, int(good)))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r["terms"]: r for r in quality.held_out(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("source"), F.col("lang")).collect()}
    alone, with_site = got["document"], got["document and site"]
    assert alone["documents"] > 1_500 and alone["accuracy"] < 0.7
    assert with_site["accuracy"] > alone["accuracy"] + 0.15 and with_site["log_loss"] < alone["log_loss"] - 0.1


def test_language_is_that_of_the_least_compressed_size(spark):
    rng = random.Random(12)
    words = {"aa": ["the", "house", "with", "great"], "bb": ["casa", "perro", "grande", "porque"], "cc": ["und", "nicht", "schön", "größer"]}
    content = {lang: " ".join(rng.choices(w, k=400)).encode() for lang, w in words.items()}
    texts = [" ".join(rng.choices(words[rng.choice(list(words))], k=n)) for n in (1, 3, 30, 700) for _ in range(8)] + ["The HOUSE casa", "und " * 3_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, content).collect()}
    for k, text in enumerate(texts):
        data, sizes = text.lower().encode(), {}
        for lang, held in content.items():
            made = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(press.compress(data[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(data), language_id.BLOCK_BYTES))
        first, second = sorted(sizes.values())[:2]
        assert sizes[got[k]["lang_pred"]] == first and got[k]["score"] == pytest.approx((second - first) / second)


def test_very_long_texts(spark):
    long_text = "palabra otra " * 150_000
    docs = spark.createDataFrame([(k, long_text if k == 3 else f"word{k} other text with some letters", "es" if k == 3 else "en", "a" if k < 30 else "b", 0) for k in range(40)], DOCS)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixture.mix(docs).collect()}
    assert taken[3][0] == 300_000 and taken[3][1] <= 600_000 and len(taken) == 40
    found = {r["doc_id"]: r for r in language_id.classify(docs).collect()}
    assert len(found) == 40 and 0 <= found[3]["score"] <= 1
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(40)], "doc_id long, quality int")
    scores = quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(scores) == 40 and all(0 <= r["quality_score"] <= 1 for r in scores)


def test_archives_of_pages_with_columns_of_the_same_names(spark):
    rows = [(k, f"http://a/{k}", "same" if k % 2 else f"<p>{k}</p>", k, 1, True, b"x", "s") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page long, size int, maybe boolean, payload binary, sha string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect()}
    assert got == {k: ("revisit", 1, 4) if k % 2 and k > 1 else ("response", None, 4 if k % 2 else len(f"<p>{k}</p>")) for k in range(12)}


def test_vectors_of_rows_that_share_an_id_are_candidates_each(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 6))
    ids = [k if k < 50 else k - 9 for k in range(60)]
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        score = x @ x[ids.index(q)]
        want = sorted(((-s, i) for s, i in zip(score, ids, strict=True) if i != q))[:10]
        assert Counter(i for i, _ in got[q]) == Counter(i for _, i in want)
