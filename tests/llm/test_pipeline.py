"""The corpus pipeline against a brute-force version, and its stages one by one."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import language_id, mixture
from cartulary.llm.queries import byte_pattern, tokenizer_path

WORDS = {"aa": ["the", "house", "with", "great", "which", "there"], "bb": ["casa", "perro", "grande", "porque", "entonces", "mucho"], "cc": ["und", "nicht", "schön", "größer", "warum", "zwischen"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, maybe int, row int, copies int"


def corpus():
    rng = random.Random(31)
    rows = []
    for k in range(150):
        lang = rng.choice(list(WORDS))
        rows.append((" ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 30)) for _ in range(rng.randint(8, 60))), lang))
    for k in range(0, 40, 2):
        words = rows[k][0].split()
        rows.append((rows[k][0].replace(" ", "  "), rows[k][1]))
        if len(words) > 40:
            words[3] = "changed"
        rows.append((" ".join(words), rows[k][1]))
    rows += [(None, "aa"), ("", "bb"), ("12 34 !", None), ("?", "cc")]
    sources = [rng.choice(["s1", "s2", "s3", None]) if k % 3 else "hot" for k in range(len(rows))]
    return [(k, t, lang, sources[k], 0, 1, 2, 3) for k, (t, lang) in enumerate(rows)]


def near(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y) >= 0.8


def brute(rows, spark):
    """doc_id and digest of every copy."""
    tiktoken = pytest.importorskip("tiktoken")
    train = sorted(((hashlib.md5(str(r[0]).encode()).hexdigest(), r[1][: language_id.PIECE_CHARS], r[2]) for r in rows if r[2] and r[1] and re.search(r"[^\W\d_]", r[1]) and zlib.crc32(str(r[0]).encode()) % 4 != 2), reverse=True)
    pieces = defaultdict(list)
    for _, piece, lang in train:
        pieces[lang].append(piece.lower().encode())
    c = language_id.Classifier(tuple((k, b"\n".join(v)) for k, v in sorted(pieces.items())))
    kept = [r for r in rows if c.predict(r[1])[1] >= language_id.MIN_MARGIN]
    seen, unique = set(), []
    for r in kept:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if key not in seen:
            seen.add(key)
            unique.append(r)
    root = list(range(len(unique)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(unique)):
        for j in range(i):
            if near(unique[i][1], unique[j][1]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    single = [r for i, r in enumerate(unique) if find(i) == i]
    # the mixture has a brute-force test of its own; here its plan is taken as it is
    mix = {r["doc_id"]: r["copies"] for r in mixture.mix(spark.createDataFrame(single, SCHEMA)).collect()}
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    code = tiktoken.Encoding("t", pat_str=byte_pattern(), mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for r in single:
        ids = code.encode_ordinary(r[1])
        out[(r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())] += mix[r[0]]
    return Counter({k: n for k, n in out.items() if n}), len(kept), len(unique), len(single)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    want, kept, unique, single = brute(rows, spark)
    assert len(rows) > kept > unique > single
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_odd_tables(spark, name, stage):
    """Nulls in every column, empty texts, repeated rows, clashing names, an empty table."""
    good = " ".join(["the great house"] * 5)
    rows = [(1, good, "aa", "s", 0, 1, 2, 3), (1, good, "aa", "s", 0, 1, 2, 3), (None, None, None, None, None, None, None, None), (2, "", "bb", None, 0, 1, 2, 3), (3, "la casa grande y el perro " * 4, "bb", "t", 0, 1, 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} <= {None, 1, 2, 3}
    if name in ("exact_dedup", "ngram_jaccard_join"):
        assert Counter(r["doc_id"] for r in out.collect())[1] == 1
    assert stage(spark, docs.filter(F.lit(False)), "").count() == 0
