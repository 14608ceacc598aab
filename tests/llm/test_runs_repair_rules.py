"""Runs, repair of conversations and decision lists against plain versions, and their defined cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cartulary.llm import mixture, periodic, queries, repair, rules, warc
from cartulary.llm.wording import numbered

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Runs by comparing words at every distance."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                out.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_a_comparison_at_every_distance():
    rnd = random.Random(1)
    for least in (12, 5, 2):
        for _ in range(120):
            texts = []
            for _ in range(rnd.randint(1, 5)):
                base = [rnd.randrange(3) for _ in range(rnd.randint(1, 30))]
                w: list[int] = []
                while len(w) < rnd.randint(0, 110):
                    w += base[rnd.randrange(len(base)) :] if rnd.random() < 0.4 else base
                    w += [rnd.randrange(9)] if rnd.random() < 0.3 else []
                texts.append([str(x).encode() for x in w])
            assert periodic.runs_of(*numbered(texts), least) == [plain_runs(t, least) for t in texts]


def test_runs_of_long_texts_stay_in_bounds():
    one, lines = [b"a"] * 30_000, sum([[*(b"w%d" % k for k in range(10)), b"x%d" % i] for i in range(3_000)], [])
    assert periodic.runs_of(*numbered([one, lines])) == [[(0, 30_000, 1)], []]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 2_000:
        a, b = b, b + a
    assert periodic.runs_of(*numbered([b])) == [plain_runs(b)]


def test_runs_query_equals_the_plain_version(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, TINY).collect()}
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got.values()) > 5
    for d, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1_200:
            continue
        found = plain_runs(w)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        row = got[d]
        assert row["n_runs"] == len(found)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)


def test_runs_of_defined_cases(spark):
    text = "Ä b " * 8 + "end"
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, text, "x"), (3, text, "x"), (4, "\x0b one\x1ctwo \n", "x")], "id long, text string, runs string")
    got = periodic.with_runs(df).select("id", "runs", "periodic.n_words", "periodic.runs", "periodic.collapsed").collect()
    assert [r[2] for r in got] == [0, 0, 17, 17, 1] and all(r[1] == "x" for r in got)
    assert [[tuple(x) for x in r[3]] for r in got] == [[], [], [(0, 16, 2)], [(0, 16, 2)], []]
    assert [r[4] for r in got] == ["", "", "Ä b end", "Ä b end", "one\x1ctwo"]
    assert periodic.with_runs(df.limit(0)).count() == 0


def plain_repair(rows: list[tuple]) -> tuple:
    """Numbers, edits and text of the cheapest repair, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best, seen, count = {0: (0, "", ())}, set(), [0, 0, 0]

    def offer(into, q, way):
        if q not in into or way[:2] < into[q][:2]:
            into[q] = way

    def put_in(ways):
        for _ in range(3):
            for q, (c, a, o) in list(ways.items()):
                role = "assistant" if q == 2 else "user"
                offer(ways, after[q, role[0]], (c + 2, a + "I", (*o, f"{role}:")))

    for _, role, text in rows:
        put_in(best)
        end = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not end else "again" if (role, text) in seen else "cut" if end[-1] not in ".!?" else ""
        for k, name in enumerate(("blank", "again", "cut")):
            count[k] += fault == name
        seen.add((role, text))
        then: dict = {}
        for q, (c, a, o) in best.items():
            offer(then, q, (c + 3, a + "D", o))
            if fault not in ("blank", "again"):
                more = fault == "cut"
                for to in ("user", "assistant"):
                    if (q, to[0]) in after:
                        offer(then, after[q, to[0]], (c + 2 + more, a + "R", (*o, f"{to}:{text}")))
                if (q, role[:1]) in after:
                    offer(then, after[q, role[:1]], (c + more, a + "K", (*o, f"{role}:{text}")))
        best = then
    put_in(best)
    cost, audit, out = min(way for q, way in best.items() if q in (0, 3))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return gaps, *count, illegal, cost, audit, "\n".join(out)


def after_damage(rows: list[tuple]) -> dict:
    """Rows by conversation after the damage that the query does."""
    out: dict = {}
    for c, t, role, text in rows:
        held = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def held_against(spark, rows: list[tuple]) -> None:
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("keys", repair.F.lit("x")).repartition(3)
    hashes = {r[0]: tuple(r)[1:] for r in repair.digests(repair.damaged(df)).collect()}
    texts = {r[0]: tuple(r)[1:] for r in repair.repairs(repair.damaged(df), gone="gone").collect()}
    want = {c: plain_repair(v) for c, v in after_damage(rows).items()}
    assert texts == want
    assert hashes == {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}


def random_rows(rnd: random.Random, conv: int | None, n: int) -> list[tuple]:
    roles, texts = ("user", "assistant", "system", "tool", "u", "", None), ("a.", "b", "c!", "  ", "", None, "d?\n", "e")
    text = lambda t: rnd.choice(texts) if rnd.random() < 0.5 else f"x{t}" + rnd.choice([".", "", "!"])
    return [(conv, t * rnd.choice([1, 1, 2]) + 1000 * t, rnd.choice(roles), text(t)) for t in range(n)]


def test_repair_equals_a_dynamic_programme_row_by_row(spark):
    rnd = random.Random(5)
    rows = sum([random_rows(rnd, c, rnd.randint(0, 20)) for c in range(150)], [])
    held_against(spark, [*rows, *random_rows(rnd, None, 12), (900, None, "user", "one."), (900, 4, "assistant", "two.")])


def test_repair_of_conversations_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 7)
    rnd = random.Random(6)
    same = [(8, t, "user" if t % 2 == 0 else "assistant", "same.") for t in range(120)]
    held_against(spark, [*random_rows(rnd, 5, 400), *random_rows(rnd, 6, 3), *same, (9, None, None, None)])


def test_repair_query_equals_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, TINY).collect()}
    want = {c: plain_repair(v) for c, v in after_damage(rows).items()}
    assert got == {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}


def test_repair_of_ties_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digests(repair.damaged(df)).count() == 0 and repair.repairs(df).count() == 0
    rows = [("c", 1, "user", "b."), ("c", 1, "user", "b."), ("c", 1, "assistant", "a."), ("d", 2, "user", "x" * 200_000 + ".")]
    got = [
        {r["conv_id"]: (r["duplicate"], r["cost"], r["audit"], hashlib.sha256(r["repaired"].encode()).hexdigest()) for r in repair.repairs(d).collect()}
        for d in (spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(n) for n in (1, 4))
    ]
    assert got[0] == got[1] and got[0]["c"][0] == 1 and got[0]["d"][1:3] == (2, "KI")


def test_ropes_compare_as_their_texts():
    rnd = random.Random(2)
    for _ in range(500):
        made = []
        for _ in range(2):
            text = "".join(rnd.choice("DK") for _ in range(rnd.randint(0, 6)))
            rope: repair.Rope | str = ""
            for c in text:
                rope = repair.Rope(rope, c) if rnd.random() < 0.7 else repair.Rope(repair.Rope("", rope), repair.Rope(c, ""))
            made.append((text, rope))
        (a, x), (b, y) = made
        assert repair.before(x, y) == (a < b) and "".join(repair.leaves(x)) == a


def test_grammar_repeats_nothing_and_says_the_same():
    rnd = random.Random(3)
    sequences = [[rnd.choice([0, 3, 6, 4]) for _ in range(rnd.randint(0, 12))] for _ in range(200)] + [[3] * 9, [3] * 9]
    grammar = repair.Grammar()
    short = grammar.compressed(sequences)
    back = {made: pair for pair, made in grammar.rule.items()}
    expand = lambda s: [s] if s not in back else expand(back[s][0]) + expand(back[s][1])
    assert [sum(map(expand, s), []) for s in short] == sequences
    pairs = Counter(p for s in short for p in zip(s, s[1:], strict=False) if p[0] != p[1])
    assert not pairs or max(pairs.values()) == 1
    assert len(grammar.matrix) == 12 + len(grammar.rule)


def test_counts_equal_plain_counts(spark):
    got = {r["doc_id"]: r for r in queries.op13_quality_rules(spark, TINY).collect()}
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, text in rows:
        text = text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)
        assert tuple(got[d])[1:6] == want
        assert got[d]["base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and not (got[d]["base_failed"] and got[d]["kept"])


def test_rules_find_planted_thresholds():
    rnd = np.random.default_rng(1)
    x = {name: rnd.random(3_000) for name in rules.MEASURES}
    bad = ((x["symbol_share"] >= 0.8) & (x["words"] < 0.5)) | (x["upper_share"] >= 0.9)
    made = rules.learned(x, ~bad)
    rows = np.arange(3_000)
    dropped = np.zeros(3_000, bool)
    for rule in made.rules:
        dropped[rules.holds(rule, x, rows)] = True
    assert made.otherwise and not made.verdict and (dropped == bad).mean() > 0.98
    assert {c.measure for rule in made.rules for c in rule} >= {"symbol_share", "words", "upper_share"}
    assert "else keep" in rules.text_of(made)


def test_rules_as_an_expression_agree_with_rules_as_numbers(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    made = rules.fitted(docs, labels)
    assert made.rules
    sample = rules.labelled(docs, labels).toPandas()
    x = {name: sample[name].to_numpy(float) for name in rules.MEASURES}
    dropped = np.zeros(len(sample), bool)
    for rule in made.rules:
        dropped[rules.holds(rule, x, np.arange(len(sample)))] = True
    judged = rules.judged(docs, made).join(labels.select("doc_id", "quality"), "doc_id").selectExpr("kept", "base_failed", "quality").toPandas()
    assert (~judged["kept"] & ~judged["base_failed"]).sum() == dropped.sum() - (dropped[[bool(b) for b in failed(sample)]]).sum()
    good = judged[judged["quality"] == 1]
    assert (good["kept"] | good["base_failed"]).mean() > 0.98
    assert judged[judged["quality"] == 0]["kept"].mean() < 0.1


def failed(sample) -> list[bool]:
    return [w < 10 or 100 * round(s * w) > 20 * w for w, s in zip(sample["words"], sample["repeated_words"], strict=True)]


def test_rules_hold_on_labels_that_they_have_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    made = rules.fitted(docs, labels.filter("doc_id % 3 <> 0"))
    unseen = rules.judged(docs, made).join(labels.filter("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").filter("not base_failed").toPandas()
    assert len(unseen) > 50 and (unseen["kept"] == (unseen["quality"] == 1)).mean() > 0.95


@pytest.mark.parametrize("quality", [None, 0, 1])
def test_rules_of_one_kind_of_labels_and_defined_cases(spark, quality):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 40_000, 5), (None, "a b", 5), (2, "x", 5)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, quality), (77, 0), (None, 1)], "doc_id long, quality int")
    made = rules.fitted(docs, labels)
    assert made.rules == () and made.otherwise == (quality != 0)
    got = rules.judged(docs, made).collect()
    assert sorted(r["n_words"] for r in got) == [0, 0, 1, 2, 40_000] and not any(r["kept"] for r in got)
    assert rules.judged(docs.limit(0), rules.fitted(docs.limit(0), labels)).count() == 0


def foreign(kind: str, identifier: str | None, block: bytes, version: str = "1.0", **fields: object) -> bytes:
    """A record as other writers make them."""
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *([f"WARC-Record-ID: <{identifier}>"] if identifier else []), *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    body = "<p>é</p>".encode()
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n" + warc.to_chunks(body)
    records = [
        foreign("warcinfo", "urn:uuid:0", b"software: x\r\n"), foreign("request", "urn:uuid:1", b"GET / HTTP/1.1\r\n\r\n"),
        foreign("response", "urn:uuid:2", plain, WARC_Target_URI="<http://a/>", WARC_Payload_Digest=f"sha1:{sha}"),
        foreign("response", "urn:uuid:3", chunked, "1.1", WARC_Payload_Digest="sha256:abc", X_Note="folded\r\n  line"),
        foreign("resource", "urn:uuid:4", b"HTTP/ is text here"), foreign("revisit", "urn:uuid:5", b"", WARC_Refers_To="<urn:uuid:2>"),
        foreign("metadata", None, b"k: v"), foreign("strange", "urn:uuid:6", b"?"), foreign("response", "urn:uuid:7", plain, WARC_Payload_Digest="sha1:" + "A" * 32),
        foreign("response", "urn:uuid:8", plain[:30], WARC_Segment_Number=1), foreign("continuation", "urn:uuid:9", plain[30:], WARC_Segment_Origin_ID="<urn:uuid:8>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(plain)),
        foreign("continuation", "urn:uuid:11", b"tail", WARC_Segment_Origin_ID="<urn:uuid:10>", WARC_Segment_Number=2, WARC_Segment_Total_Length=9),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:6])))
    (tmp_path / "b.warc").write_bytes(b"".join(records[6:]))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc.gz", "b.warc")], "path string")
    got = {r["record_id"][9:]: r for r in warc.read(files, strict=False).collect()}
    assert set(got) == {"2", "3", "4", "5", "7", "8", "10"} and all(r["page_id"] is None for r in got.values())
    assert {k: (bytes(r["payload"]) if r["payload"] is not None else None, r["digest_ok"]) for k, r in got.items()} == {
        "2": (body, True), "3": (body, None), "4": (b"HTTP/ is text here", None), "5": (None, None), "7": (body, False), "8": (body, None), "10": (None, False),
    }
    assert got["2"]["url"] == "http://a/" and got["5"]["refers_to_id"] == "urn:uuid:2" and got["4"]["payload_digest"] == warc.digest(b"HTTP/ is text here")
    kinds = {r["record_type"]: r["n"] for r in warc.inventory(files).groupBy("record_type").agg(repair.F.sum("records").alias("n")).collect()}
    assert kinds == {"warcinfo": 1, "request": 1, "response": 4, "resource": 1, "revisit": 1, "metadata": 1, "strange": 1, "continuation": 2}
    with pytest.raises(Exception, match="digest|missing"):
        warc.read(files).collect()


def test_one_grouping_is_balanced_in_one_step(spark, monkeypatch):
    cells = spark.createDataFrame([("a", 10.0), ("b", 40.0), (None, 5.0), ("c", 0.0), ("d", 8.0)], "cell string, size double")
    targets = spark.createDataFrame([("a", 15.0), ("b", 20.0), (None, 10.0), ("c", 3.0), ("d", 0.0)], "group string, target double")
    made: list[str] = []
    keep = mixture.materialise
    monkeypatch.setattr(mixture, "materialise", lambda df, what: made.append(what) or keep(df, what))
    rates = {r["cell"]: r["rate"] for r in mixture.balanced(cells, [("cell", targets)]).collect()}
    assert rates == pytest.approx({"a": 1.5, "b": 0.5, None: 2.0, "c": 0.0, "d": 0.0}) and made.count("lambdas") == 2
