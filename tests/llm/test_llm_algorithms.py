"""The algorithms of the training-data operators without Spark, against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from cartulary.llm import ann, byte_bpe, exact_dedup, language_id, near_dup, quality, substring_dedup, suffixes, token_file, warc
from cartulary.llm.queries import byte_pattern, tokenizer_path

TEXTS = ["", " ", "Hello world, it's 2024!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve — Ünïcode 日本語 🙂", "x" * 3000, "\t\n\r  mixed   spaces\n\n", "don't WON'T 's 're", "<|endoftext|>", "a\x00b\x1cc\x85d", "ÉÈ éè ΣΑΣ İ K ß", "1234567890 12,5"]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(tokenizer_path("byte_bpe_50k.tiktoken"), byte_pattern())


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=byte_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(vocabulary, library):
    rng = random.Random(5)
    alphabet = "abcdeéñ 's.,!?12\n 日🙂AB"
    more = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    for text in [*TEXTS, *more]:
        ids = vocabulary.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_backtracking_equals_plain_merging_on_any_bytes(vocabulary):
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choices(b"abcthein \xc3\xa9\xff\x00", k=rng.randint(1, 30)))
        want = [vocabulary.ranks[p] for p in vocabulary.merged(data)] if data not in vocabulary.ranks else [vocabulary.ranks[data]]
        assert vocabulary.encode_piece(data) == want


def test_memory_of_pieces_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES_KEPT", 10)
    for k in range(50):
        vocabulary.encode(f"word{k}xyz")
    assert len(vocabulary.pieces) <= 10


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 49407, 1, 70000, 2**31], list(range(0, 66000, 7))])
def test_directly_addressable_codes(ids):
    data = token_file.to_bytes([3, None], np.array([0, len(ids) // 2, len(ids)]), np.array(ids, np.uint32))
    f = token_file.TokenFile(data)
    assert f.doc_ids == [3, None]
    assert [f[i] for i in range(0, len(ids), 13)] == ids[::13]
    assert [*f.document(0), *f.document(1)] == ids
    for a, b in ((0, 0), (1, 5), (511, 514), (5, len(ids))):
        if a <= b <= len(ids):
            assert f.slice(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        f[len(ids)]


def test_words_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(7)
    more = ["".join(rng.choices("abzßéÉ 0!'*~{s.tß\n\t×ª²KİΣ日", k=rng.randint(1, 50))) for _ in range(500)]
    more += ["a <|endoftext|> b", "<|STARTOFTEXT|> x", "x<|startoftext|>y <|endoftext|>\n<|endoftext|>", "<|endoftext|", "日<|endoftext|>É"]
    got = token_file.Words(path).encode([*TEXTS, *more, None])
    for text, ids in zip([*TEXTS, *more, ""], got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_words_are_looked_up_once_a_batch(monkeypatch):
    pytest.importorskip("tokenizers")
    seen = []
    monkeypatch.setattr(token_file.Remembered, "__getitem__", lambda self, key: seen.append(key) or dict.__getitem__(self, key), raising=False)
    words = token_file.Words(tokenizer_path("word_bpe_49k.json"))
    got = words.encode(["the cat's 12 " * 5_000, "", "The cat " * 5_000])
    assert len(seen) <= 5 and list(map(len, got)) == [4 * 25_000, 0, 4 * 10_000]


def test_cut_equals_the_pattern():
    rng = random.Random(11)
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
    for size in range(600):
        text = "".join(rng.choices("a'bs'tm'drevlé \n0!.", k=size % 60))
        starts, pieces = token_file.cut(np.frombuffer(text.encode("latin-1"), np.uint8))
        assert [(m.start(), m[0]) for m in pattern.finditer(text)] == [(int(at), p.decode("latin-1")) for at, p in zip(starts, pieces.to_pylist(), strict=True)], text


def test_remembered_keeps_what_is_used():
    m = token_file.Remembered(3)
    m.update(a=1, b=2, c=3, d=4)
    assert m.lacking({"a", "x"}) == ["x"] and m["a"] == 1 and len(m) == 1
    assert m.lacking({"d"}) == [] and m["d"] == 4


def test_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(150):
        t = rng.integers(0, rng.integers(1, 5), size=rng.integers(1, 260)).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t, 3)
        order = suffixes.suffix_array(t)
        b = t.tobytes()
        keys = [b[i : i + 100] for i in order]
        assert sorted(order.tolist()) == list(range(len(b))) and keys == sorted(keys)
    assert len(suffixes.suffix_array(np.zeros(0, np.uint8))) == 0


def test_common_prefixes():
    t = np.frombuffer(b"abcdefghijkl" * 20 + b"X" + b"abcdefghijkl" * 20, np.uint8)
    w = suffixes.words(t)
    assert suffixes.common_prefixes(np.array([0, 0, 1]), np.array([12, 241, 241]), w, 100).tolist() == [100, 100, 0]
    assert suffixes.common_prefixes(np.array([230]), np.array([218]), w, 100).tolist() == [10]


def test_pieces_cover_every_start_once():
    rng = np.random.default_rng(3)
    docs = [rng.integers(97, 100, size=n).astype(np.uint8) for n in (50, 100, 101, 5000)]
    data = np.concatenate(docs)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc, ends = substring_dedup._places(offsets, 0, len(data))
    start, count, seed, content = substring_dedup.pieces(data, ends, 0, len(data), substring_dedup.Frequent(np.zeros(0, np.uint64)))
    got = sorted(i for s, c in zip(start, count, strict=True) for i in range(s, s + c))
    want = [i for k in range(4) for i in range(offsets[k], max(offsets[k], offsets[k + 1] - 99))]
    assert got == want and count.max() <= 69
    # equal strings have equal seeds
    by = {}
    for s, c, v in zip(start, count, seed, strict=True):
        for i in range(s, s + c):
            assert by.setdefault(data[i : i + 100].tobytes(), v) == v


def test_packing_round_trip():
    cols = tuple(np.array(x, np.uint64) for x in ([2**47, 5], [2**48 - 1, 0], [2**64 - 1, 2**63], [0, 9], [2**39, 1], [69, 1]))
    assert [c.tolist() for c in substring_dedup._unpacked(substring_dedup._packed(cols))] == [c.tolist() for c in cols]


def test_bloom_never_misses_a_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, size=3000)
    bits = exact_dedup.filter_bits(3000)
    assert bits & (bits - 1) == 0 and exact_dedup.filter_bits(10**12, 1 << 20) == 8 << 20
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in (h[:2000], h[1000:]):
        o, t = np.zeros_like(once), np.zeros_like(twice)
        at, n = np.unique(exact_dedup.probes(part, bits).ravel(), return_counts=True)
        exact_dedup._set(t, at[n > 1])
        exact_dedup._set(o, at)
        once, twice = exact_dedup._merge((once, twice), o, t)
    hit = exact_dedup._get(twice, exact_dedup.probes(h, bits)).all(axis=1)
    assert hit[1000:2000].all() and hit[:1000].mean() < 0.2


def test_banding_reaches_its_recall():
    bands, rows = near_dup.banding()
    assert bands * rows <= near_dup.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= near_dup.RECALL


def brute(sets, threshold=0.8):
    m = len(sets)
    out = np.zeros((m, m), bool)
    for i in range(m):
        for j in range(m):
            u = len(sets[i] | sets[j])
            out[i, j] = i != j and u > 0 and len(sets[i] & sets[j]) / u >= threshold - 1e-12
    return out


def test_links_equal_brute_force():
    rng = random.Random(2)
    base = [rng.sample(range(1000), 40) for _ in range(4)]
    sets = []
    for k in range(120):
        s = set(base[k % 4])
        for _ in range(rng.randint(0, 9)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(1000, 1200))
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = brute(sets)
    assert (near_dup.linked(arrays, None, 0.8) == want).all()
    assert (near_dup.linked(arrays[:50], arrays[50:], 0.8) == want[:50, 50:]).all()
    mine, _ = near_dup._roots(want, True)
    assert all(mine[i] == mine[j] for i in range(120) for j in range(120) if want[i, j])


def test_exactly_at_the_threshold():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)  # 8 of 10
    assert near_dup.linked([a, b], None, 0.8)[0, 1] and not near_dup.linked([a, b[:-1] + 100], None, 0.8)[0, 1]


def test_short_texts_are_one_gram():
    s = near_dup.Shingler(5)
    assert len(s.ngrams(b"")) == 0 and len(s.ngrams(b"a b")) == 1 and len(s.ngrams(b"a b c d e f")) == 2
    assert (s.ngrams(b"a  b\nc") == s.ngrams(b"a b c")).all()


def test_chunked_framing():
    for payload in (b"", b"x", b"ab\r\n" * 9000):
        assert warc.from_chunks(warc.to_chunks(payload)) == payload
    assert warc.from_chunks(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.from_chunks(b"2\r\nabc\r\n0\r\n\r\n")


def test_segments_are_checked():
    payload = b"z" * 1000
    parts = [next(warc.parse(r)) for r in warc.records_of(7, "http://a/ b", payload, hashlib.sha1(payload).digest(), len(payload), None, False, "0-0", 300)]
    rows = [{"record_id": f["warc-record-id"].strip("<>"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "payload_digest": f.get("warc-payload-digest"), "payload": b, "origin_id": "o", "segment": int(f["warc-segment-number"]), "total_length": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None} for f, b in parts]
    assert len(rows) > 3
    shuffled = pd.DataFrame(rows[::-1])
    out = warc.reassemble(shuffled).iloc[0]
    assert out["payload"] == payload and out["page_id"] == 7 and out["url"] == "http://a/%20b"
    with pytest.raises(ValueError):
        warc.reassemble(pd.DataFrame(rows[:1] + rows[2:]))
    bad = pd.DataFrame(rows)
    bad.loc[len(rows) - 1, "total_length"] = 1
    with pytest.raises(ValueError):
        warc.reassemble(bad)


def test_language_of_blocks():
    c = language_id.Classifier((("a", b"the cat and the dog went to the house " * 50), ("b", b"el gato y el perro fueron a la casa " * 50)))
    assert c.predict("The dog and the cat went to the house")[0] == "a" and c.predict("la casa y el perro")[0] == "b"
    assert c.predict(None) == c.predict("12 !? ") == ("und", 0.0)
    assert language_id.Classifier(()).predict("abc") == ("und", 0.0)


def test_measures_of_odd_texts():
    for t in (None, "", "   ", "word", "***", "日本語 " * 10):
        x = quality.measures(t)
        assert x.shape == (quality.FEATURES,) and np.isfinite(x).all()


def test_balanced_parts_and_router():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(200, 16)) * 0.5 for c in centers])
    graph = ann.nearest(x / np.linalg.norm(x, axis=1, keepdims=True), 8)
    label = ann.balanced(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.1 * len(x) / 8) + 1
    assert (label[graph] == label[:, None]).mean() > 0.8
    router = ann.fit(x, 20_000)
    assert router.probes < router.w2.shape[1]


def test_compare_breaks_ties_by_id():
    v = [1.0, 2.0]
    q = pd.DataFrame({"vec_id": [0], "v": [v], "bound": [-np.inf]})
    rows = pd.DataFrame({"vec_id": [9, 3, 0, 5], "v": [v, v, v, [0.5, 1.0]]})
    got = ann.compare(q, rows, 2)
    assert got["vec_id"].tolist() == [3, 9] and got["score"].tolist() == [5.0, 5.0]
    assert ann.compare(q.assign(bound=5.0), rows, 3)["vec_id"].tolist() == [3, 9]


def test_base32_digest():
    assert warc.digest(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def test_single_ids_need_few_bytes():
    ids = np.random.default_rng(2).integers(0, 49408, 200_000)
    data = token_file.to_bytes([1], np.array([0, len(ids)]), ids.astype(np.uint32))
    read = []

    def fetch(at, n):
        read.append(n)
        return data[at : at + n]

    f = token_file.TokenFile(fetch)
    assert [f[k] for k in (0, 77_777, 199_999)] == ids[[0, 77_777, 199_999]].tolist() and sum(read) < 1000


def test_parts_of_parts_find_neighbours(monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 60)
    monkeypatch.setattr(ann, "MOST_PARTS", 8)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(60, 16)) * 0.4 for c in centers])
    top = ann.fit(x, len(x))
    place = top.part(x)
    inner = {p: ann.fit(x[place == p], int((place == p).sum()), ann.INNER_TARGET) for p in range(8) if (place == p).sum() > 120}
    routers = ann.Routers(top, inner)
    assert routers.first[-1] > 20 and routers.most < routers.first[-1] / 2
    places = routers.part(x)
    rows, seen, turn = routers.parts(x[::20])
    assert (np.diff(rows) >= 0).all() and (turn[np.append(True, np.diff(rows) > 0)] == 0).all()
    visited = [set(seen[rows == k]) for k in range(len(x[::20]))]
    near = ann.nearest(x, 20)[::20]
    assert np.mean([places[v] in visited[k] for k in range(len(near)) for v in near[k]]) >= 0.9


def test_more_neighbours_need_more_parts():
    """Parts visited follow the number of neighbours that are looked for, and hold them."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(150, 16)) * 0.8 for c in centers])
    asked = np.arange(0, len(x), 20)
    probes = []
    for k in (5, 20, 600):
        router = ann.fit(x, 20_000, k=k)
        place = router.part(x)
        seen = np.argsort(-router.scores(x[asked]), axis=1, kind="stable")[:, : router.probes]
        near = ann.nearest(x, k, asked)
        assert (place[near][:, :, None] == seen[:, None, :]).any(axis=2).mean() >= 0.9
        probes.append(router.probes)
    assert (ann.nearest(x, 20, asked) == ann.nearest(x, 20)[asked]).all()
    assert probes == sorted(probes) and probes[0] < probes[-1]


def test_crowded_filters_set_fewer_bits():
    assert [exact_dedup.probe_count(n, 1 << 20) for n in (1, 1 << 16, 1 << 17, 1 << 18, 1 << 30)] == [4, 4, 2, 1, 1]
    h = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 1 << 16)
    bits = 1 << 17
    seen = {}
    for count in (1, 4):
        n = np.bincount(exact_dedup.probes(h, bits, count).ravel().astype(np.int64), minlength=bits)
        seen[count] = (n[exact_dedup.probes(h, bits, count).astype(np.int64)] > 1).all(axis=1).mean()
    assert seen[1] < 0.5 < seen[4]


def test_logistic_learns_words():
    bins, rng = quality.Bins(), random.Random(9)
    good = [rng.random() < 0.5 for _ in range(400)]
    texts = [" ".join(rng.choices(["tea", "cup", "sun", "good" if g else "bad"], k=20)) for g in good]
    x, grams = np.zeros((400, 28)), [bins(t) for t in texts]
    w, v = quality.logistic(x[:300], np.array(good[:300], float), grams[:300])
    found = [w[0] + v[g].sum() / np.sqrt(len(g)) > 0 for g in grams[300:]]
    assert np.mean([a == b for a, b in zip(found, good[300:], strict=True)]) > 0.97
    assert len(bins(None)) == len(bins("  ")) == 0
