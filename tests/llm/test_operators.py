"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eavista.llm import components as contraction
from eavista.llm import (
    embedding_dedup, exact_dedup, language, minhash_dedup, mixing, packing, suffix_dedup, token_files, tokens, toxicity,
    url_filter,
)
from eavista.llm.queries import vocabulary
from eavista.llm.shared import utf8

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edited(text: str, at: int) -> str:
    words = text.split(" ")
    words[at] = "changed"
    return " ".join(words)


def rows():
    shared, base = prose(1, 30), prose(2, 120)
    texts = [base, base, edited(base, 60), "head one " + shared + " tail", "other head " + shared, None, "", "a", "a b",
             "x" * 300, "x" * 200, prose(3, 4000), base.upper(), "  \n\t ", shared[:49], shared]
    return [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}" if i % 5 else None, i) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns with names that the operators use for themselves.
    extra = ", component long, key string, n long, h long, label string, vertex long"
    return spark.createDataFrame([r + (7, "k", 1, 2, "l", 9) for r in rows()], SCHEMA + extra)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def test_repeated_passages(docs, nothing):
    found, seen = by_id(suffix_dedup.repeated_passages(docs)), set()
    for doc_id, text, *_ in rows():
        data = (text or "").encode()
        own = [data[i : i + 50] for i in range(len(data) - 49)]
        gone = np.zeros(len(data) + 2, bool)
        for i, stretch in enumerate(own):
            if stretch in seen:
                gone[i + 1 : i + 51] = True
        seen.update(own)
        kept = bytes(b for b, g in zip(data, gone[1:-1]) if not g)
        row = found[doc_id]
        assert (row.n_bytes, row.n_removed) == (len(data), int(gone.sum()))
        assert row.n_spans == int((np.diff(gone.astype(int)) == 1).sum())
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.repeated_passages(nothing).isEmpty()


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    text = np.random.default_rng(seed).integers(0, 1 + 3 * seed, 400).astype(np.uint8)
    raw, words = text.tobytes(), suffix_dedup.byte_words(text)
    order = suffix_dedup.suffix_array(text, words, 56)
    assert sorted(order.tolist()) == list(range(400))
    heads = [raw[i : i + 56] for i in order]
    whole = [h for h in heads if len(h) == 56]
    assert whole == sorted(whole)
    for a, b, n in zip(heads, heads[1:], suffix_dedup.common_prefixes(words, order, 56)[1:]):
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n // 8 == same // 8 or len(a) < 56 or len(b) < 56


def test_anchors_of_long_texts():
    """As if each row stood alone, also across blocks; and in memory that does not grow by several numbers a byte."""
    import tracemalloc

    values = np.random.default_rng(5)
    texts = [values.integers(97, 100, n).astype(np.uint8) for n in (0, 49, 50, 70_000, 51, 3, 131_200, 66, 2_000_000)]
    texts[6][:60_000] = texts[3][5000:65_000]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    tracemalloc.start()
    hashes, row, low, high = suffix_dedup.anchors(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * len(data)
    for i, text in enumerate(texts):
        mine = row == i
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(low[mine], high[mine])] or [np.zeros(0, int)])
        assert (starts == np.arange(max(0, len(text) - 49))).all()
        alone = suffix_dedup.anchors(text, np.array([0, len(text)]))
        assert [x.tolist() for x in (hashes[mine], low[mine], high[mine])] == [x.tolist() for x in (alone[0], *alone[2:])]
    # Equal stretches have equal anchors.
    named = [np.repeat(hashes[row == i], (high - low + 1)[row == i]) for i in (3, 6)]
    assert (named[0][5000 : 65_000 - 49] == named[1][: 60_000 - 49]).all()


def test_exact_groups(docs, nothing, spark):
    found, groups = by_id(exact_dedup.duplicate_groups(docs)), defaultdict(list)
    for doc_id, text, *_ in rows():
        groups[text or ""].append(doc_id)
    for text, ids in groups.items():
        for i in ids:
            assert (found[i].keep_id, found[i].group_size, found[i].kept) == (max(ids), len(ids), i == max(ids))
            assert found[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.deduplicated(repeated).collect())) == [
        "Row(doc_id=1, text='a')", "Row(doc_id=2, text='b')", "Row(doc_id=None, text='c')"]
    assert exact_dedup.deduplicated(nothing).isEmpty()


def test_stages_keep_columns_called_like_their_own(spark):
    own = "_sha256 string, _maybe int, _stay int, _gone int, _text string"
    rows = [(1, "a b", "x", 1, 2, 3, "t"), (2, "a b", "y", 4, 5, 6, "u"), (3, "c", "z", 7, 8, 9, "v")]
    once = spark.createDataFrame(rows, f"doc_id long, text string, {own}")
    assert sorted(map(tuple, exact_dedup.deduplicated(once).collect())) == rows[1:]
    twice = spark.createDataFrame(rows + [rows[2], (3, "d", "w", 0, 0, 0, "")], once.schema)
    kept = exact_dedup.deduplicated(twice)
    assert kept.columns == once.columns and sorted(map(tuple, kept.collect())) == sorted([*rows[1:], (3, "d", "w", 0, 0, 0, "")])


@pytest.mark.parametrize("n, span", [(1, 5), (7, 8), (1000, 1 << 40), (5, 1 << 62)])
def test_golomb_round_trip(n, span):
    values = np.unique(np.random.default_rng(n).integers(0, span, n, np.uint64))
    code = exact_dedup.golomb_encode(values, span)
    assert (exact_dedup.golomb_decode(code, len(values), span) == values).all()


def components(links, ids):
    name = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    return name


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_components(spark, monkeypatch, most):
    """Rounds alone, rounds and then one task, and one task alone give the same components."""
    monkeypatch.setattr(contraction, "MOST_LINKS", most)
    draw = np.random.default_rng(12)
    links = [(int(a), int(b)) for a, b in draw.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (300, 300)]
    found = contraction.components(spark.createDataFrame(links, "a long, b long")).collect()
    ids = {i for a, b in links if a != b for i in (a, b)}
    named = components([x for x in links if x[0] != x[1]], ids)
    assert {r.vertex: r.component for r in found} == named and len(found) == len(ids)


def test_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 16))
    table = [(i, [float(x) for x in base[i % 40] + draw.normal(size=16) * 0.05 * (i // 40)], i % 2) for i in range(160)]
    table += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [1.0] * 3, 0), (204, table[0][1], None)]
    found = by_id(embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")), "vec_id")
    links = []
    for a, v, la in table[:160]:
        for b, w, lb in table[:160]:
            if a != b and la == lb and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((a, b))
    counts, named = Counter(a for a, _ in links), components(links, [r[0] for r in table])
    assert links and len(found) == len(table)
    for i, *_ in table:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (counts[i], named[i], named[i] == i)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def test_few_fit_vectors_among_many(spark, monkeypatch):
    """Vectors that cannot be compared take no place in the training sample."""
    monkeypatch.setattr(embedding_dedup, "TRAINING_ROWS", 5)
    unfit = [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [-0.0, 0.0]]
    table = [(i, unfit[i % 5], 0) for i in range(400)] + [(i, [3.0, 4.0], 0) for i in (500, 501, 502)] + [(500, [0.0, 0.0], 0)]
    rows = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    found = embedding_dedup.near_duplicates(rows).collect()
    linked = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found if r.vec_id >= 500)
    assert linked == [(500, 2, 500, True), (500, 2, 500, True), (501, 2, 500, False), (502, 2, 500, False)]
    rest = [r for r in found if r.vec_id < 500]
    assert len(rest) == 400 and all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in rest)
    assert all(r.kept for r in embedding_dedup.near_duplicates(rows.filter("vec_id < 400")).collect())


@pytest.mark.parametrize("block, most, shingles", [(1024, 4096, 1 << 22), (4, 6, 1 << 22), (4, 4096, 100)])
def test_near_documents(docs, nothing, spark, monkeypatch, block, most, shingles):
    """Whole clusters, and clusters cut into tiles because of their documents or their shingles."""
    for name, value in (("BLOCK", block), ("MOST_DOCUMENTS", most), ("MOST_SHINGLES", shingles)):
        monkeypatch.setattr(minhash_dedup, name, value)
    base = prose(8, 200)
    table = [(i, edited(base, i * 3)) for i in range(40)] + [(50, None), (51, "one two"), (52, "ONE  two"), (53, "\n"), (None, base)]
    found = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 3, 85))

    def shingle_set(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set()

    sets = {i: shingle_set(t) for i, t in table if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    named = components(links, sets)
    for i, own in sets.items():
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(own), named[i], named[i] == i)
    assert found[None].kept and minhash_dedup.near_duplicates(nothing).isEmpty()
    assert minhash_dedup.deduplicated(docs).columns == docs.columns


def test_near_documents_of_repeated_ids(spark):
    """An id joins what any of its texts resembles."""
    a, b = prose(31, 60), prose(32, 60)
    table = [(1, a), (2, a + " x"), (5, b), (5, a + " y"), (6, b + " z"), (7, prose(33, 60)), (7, prose(34, 60)), (7, None), (8, ""), (None, a), (5, b)]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    found = minhash_dedup.near_duplicates(frame, 3, 85).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)
    wanted = [(1, 1), (2, 1), (5, 1), (5, 1), (6, 1), (7, 7), (7, 7), (7, 7), (8, 8), (None, None), (5, 1)]
    sizes = [len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) for w in ((t or "").split() for _, t in table)]
    assert got == sorted(((i, n, c, i == c) for (i, c), n in zip(wanted, sizes)), key=str)
    kept = minhash_dedup.deduplicated(frame, 3, 85)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 7, 7, 7, 8, None], key=str)


def test_urls(spark):
    urls = [None, "", "nothing", "http://NET/x", "https://a.b.net/en/", "http://x.example.net/en/1?q=/", "http://example.net",
            "http://a.example.com/de/1#t", "http://EXAMPLE.org/fr/", "ftp://u@h:80?x", "http://x.org/de/\n", "a://b://c"]
    found = by_id(url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")), "page_id")
    hosts = ["", "", "", "net", "a.b.net", "x.example.net", "example.net", "a.example.com", "example.org", "u@h:80", "x.org", "b:"]
    rules = [None] * 3 + ["net/", "net/", "example.net/en/", None, "example.com/de/", "org/fr/", None, None, None]
    for i in range(len(urls)):
        assert (found[i].host, found[i].rule) == (hosts[i], rules[i])
        assert found[i].verdict in ("allow", "block")
    assert [found[i].verdict for i in (3, 5, 7, 8)] == ["block", "allow", "block", "allow"]
    assert found[10].path == "/de/\n" and found[11].path == "//c"


def test_url_model_learns():
    texts = [f"{w}{i}.site\n/{w}/" for i in range(40) for w in ("casino", "library")]
    model = url_filter.fit(texts, [int("casino" in t) for t in texts])
    data, offsets = utf8(pa.array(["casino99.other\n/x", "library99.other\n/x"]))
    keys = url_filter.grams(data, offsets)
    scores = url_filter._margins(model.weights, model.bias, *keys, 2)
    assert scores[0] > 0 > scores[1]


def test_toxicity(spark):
    draw, table, labels = np.random.default_rng(6), [], []
    for i in range(400):
        words, toxic = prose(i, 40).split(" "), int(i % 4 == 0)
        if toxic:
            words[int(draw.integers(40))] = ("nitwitted", "scoundrel")[i // 4 % 2]
        table.append((i, " ".join(words)))
        labels.append((i, toxic))
    table += [(900, None), (901, ""), (902, prose(5, 10) + " n.i.t.w.i.t.t.e.d " + prose(6, 10)), (903, prose(7, 20)),
              (904, prose(5, 10) + " scounxdrel " + prose(6, 10)), (None, "text")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    named = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = by_id(toxicity.scored(docs, named))
    held = [(found[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert [found[i].predicted for i in (900, 901, 902, 903, 904)] == [0, 0, 1, 0, 1]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    unlabelled = toxicity.scored(docs, named.limit(0))
    assert unlabelled.filter("predicted = 1").isEmpty()


def test_languages(spark, nothing):
    own = {"aa": "kala moto sina peru tola", "bb": "schrift wald berg fluss stein"}
    table = [(i, " ".join(np.random.default_rng(i).choice(own[k].split(), 30)), k) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    table += [(100, None, None), (101, "12 - !", None), (102, "kala moto " * 30 + "schrift wald " * 10, None)]
    found = by_id(language.identified(spark.createDataFrame(table, "doc_id long, text string, lang string")))
    assert all(found[i].lang_pred == k for i, _, k in table if k)
    assert [found[i].lang_pred for i in (100, 101)] == ["und", "und"]
    assert found[102].languages == "aa,bb" and found[102].lang_pred == "aa" and 0.65 < found[102].score < 0.85
    assert language.identified(nothing).isEmpty()


HARD = ["a  b   c\n\n d \t\n e  f　  g it's 'sfoo \"'s' 12ab34 é, … ÀÉ <|endoftext|> x ", " ", "", "\n", " a\r\n\r\n", "𝔘𝔫 😀😀a",
        "'S 'LL I'M #$%'s", "a\x01b \x01", "\x1c \x85 a\x85b \u2003 \u2003x", "e\u0301 E\u0301", "İ ß Σ ΑΣ"]


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_equal_the_library(name, words):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    library.encode_special_tokens = True
    texts = HARD + [t or "" for _, t, *_ in rows()]
    wanted = [x.ids + [2] for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder, got = tokens.Encoder(vocabulary(name), words, 2), []
    for _ in range(2):
        got = [ids[a:b].tolist() for _, _, ids, at in encoder.encode(*utf8(pa.array(texts))) for a, b in zip(at, at[1:])]
        assert got == wanted


def test_token_files(docs, nothing):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0
    found = by_id(token_files.round_trip(docs, vocabulary("byte_bpe_50k.json")))
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        row = found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.round_trip(nothing, vocabulary("byte_bpe_50k.json")).isEmpty()


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    wanted = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows()}
    filled, covered = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, vocabulary("word_bpe_49k.json")).collect():
        ids = wanted[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        filled[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
    for pieces in filled.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 4096
    assert {i: sum(n for _, n in p) for i, p in covered.items()} == {i: len(x) for i, x in wanted.items()}
    assert packing.packed(nothing, vocabulary("word_bpe_49k.json")).isEmpty()


def test_packing_writes_pieces_once(docs, monkeypatch):
    names = []
    monkeypatch.setattr(packing, "stored", lambda frame, name, keep=packing.stored: names.append(name) or keep(frame, name))
    assert packing.packed(docs, vocabulary("word_bpe_49k.json")).select("doc_id").distinct().count() == len(rows())
    assert names == ["pieces"]


@pytest.mark.parametrize("text, rows, sequences", [("", 5000, 2), ("a " * 8, 3000, 7), ("a " * 40, 1000, 11)])
def test_packing_short_texts(spark, text, rows, sequences):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    found = packing.packed(docs, vocabulary("word_bpe_49k.json"))
    filled = defaultdict(list)
    for r in found.collect():
        filled[r.sequence_id].append((r.offset, r.length))
    assert len(filled) == sequences and sum(len(p) for p in filled.values()) == rows
    for pieces in filled.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 4096


def test_marks_alone_are_no_language(spark):
    model = language.LanguageModel(("aa",), np.zeros((1 << language.BITS, 1)))
    names, scores, sets = language.detect(model, ["\u0301 \u0302", "e\u0301", "123", "x"])
    assert names == ["und", "aa", "und", "aa"] and scores[0] == 0 and sets[0] == ""


def test_patterns_are_near_the_bound():
    sizes, demand = np.array([3, 5, 7, 11, 23, 30]), np.array([100, 90, 80, 70, 60, 10])
    found = packing.plan(sizes, demand, 64)
    made = np.zeros(6, int)
    for times, held in found:
        assert sum(sizes[i] * n for i, n in held.items()) <= 64
        for i, n in held.items():
            made[i] += times * n
    assert (made == demand).all()
    assert sum(t for t, _ in found) <= math.ceil((sizes * demand).sum() / 64) + len(sizes)


def test_mixing(spark, nothing):
    table = [(i, "w " * (1 + i % 7), "big" if i % 10 else ("small", None)[i // 10 % 2]) for i in range(4000)]
    own = "pass_no int, block_rank int, block int, _source string, _block int, _part int, _parts int, _tokens int"
    docs = spark.createDataFrame([r + (1, 2, 3, "s", 5, 6, 7, 8) for r in table], f"doc_id long, text string, source string, {own}")
    found = mixing.mixed(docs).collect()
    uses = Counter(r.doc_id for r in found)
    assert set(uses) == set(range(4000)) and mixing.mixed(docs).columns == docs.columns
    assert all(tuple(r)[3:] == (1, 2, 3, "s", 5, 6, 7, 8) for r in found)
    sizes = Counter()
    for i, text, source in table:
        sizes[source] += len(text.split())
    spent = Counter()
    for i, text, source in table:
        spent[source] += uses[i] * len(text.split())
    names = sorted(sizes, key=str)
    wanted = mixing.passes(np.array([sizes[s] for s in names], float), mixing.exponent_for(np.array([sizes[s] for s in names], float)))
    for name, times in zip(names, wanted):
        assert abs(spent[name] / sizes[name] - times) < 0.02 and times <= mixing.REPEATS + 1e-6
    assert mixing.mixed(nothing).isEmpty()


def test_entropy_target():
    sizes = np.array([8.0, 1.0, 1.0])
    target = 1.05
    exponent = mixing.exponent_for(sizes, target=target)
    assert abs(mixing.entropy(mixing.weights(sizes, exponent)) - target) < 1e-6
