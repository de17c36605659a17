"""Every corpus operator against a brute-force version, and on the odd cases of a fixture."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.llm import chat, classifier, ctw, decontaminate, html, linedup, neardup, packing, pii, queries, rules

SF = "/root/testdata/sf0.001"
SPACES = r"[^\x20\x09-\x0D]+"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "on", "of", "a", "the", "Été", "x1", "mail", "end."]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names used inside."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 60) for _ in range(300))
    rows = [(1, None), (2, ""), (None, "some text here"), (3, "   \n\n \t"), (4, long), (5, long), (5, long), (6, long + " tail"), (7, "one two"), (8, "One TWO"), (None, None)]
    return spark.createDataFrame([(i, t, "x", 9, "h") for i, t in rows], "doc_id long, text string, _id string, node int, _text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# --- personal data


def base_spans(text):
    def of(kind, pattern, good):
        return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]

    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = of("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    spans += of("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split(".")))
    spans += of("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)))
    spans += of("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_matches_plain_patterns(spark, docs, texts):
    rng = random.Random(3)
    pieces = ["4111 1111 1111 1111", "+1 (555) 010-2000", "a@b.co", "a@b", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1", "+12", "..", "@", "é", " ", "-", "12-34", "0.0.0.0", "\n", "+", "(", "a.b@c-d.e-f"]
    for k in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.KINDS[:4]] == base_spans(text), text
    for r in pii.find_pii(docs).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS[:4])


def test_pii_further_kinds():
    text = 'IBAN DE89 3704 0044 0532 0130 00, see https://ex.org/a?b=1. SSN: 123-45-6789 key = "abcdefghijklmnopqrstuv0123"'
    assert [text[a:b] for k, a, b in pii.find_spans(text)] == ["DE89 3704 0044 0532 0130 00", "https://ex.org/a?b=1", "123-45-6789", "abcdefghijklmnopqrstuv0123"]


def test_pii_iban_before_capitals_and_numbers():
    known = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    # a country without a fixed length: check digits made for the number
    other = next(t for t in (f"ZZ{n:02d} 1234 5678 9012 3456" for n in range(2, 99)) if pii._iban(t))
    for iban in (*known, other):
        for tail in ("", " BIC COBADEFFXXX", " EUR 1200", " 2024", " Please pay", " 99 A B C D E", ", then"):
            text = f"IBAN: {iban}{tail}"
            assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "iban"] == [iban], text
    assert not [s for s in pii.find_spans("IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX") if s[0] == "iban"]


# --- rules


def statistics(text):
    words = re.findall(SPACES, text)
    lines = [x for x in text.split("\n") if re.search(SPACES, x)]
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    hit = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, docs, texts, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rules.quality_rules(spark, docs, labels).collect()
    for r in got:
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, quality[r.doc_id]) for r in got if r.doc_id in quality]
    assert sum(k == (q == 1) for k, q in judged) >= 0.93 * len(judged)
    rows = rules.quality_rules(spark, odd, spark.createDataFrame([(2, None), (1, 0)], "doc_id long, quality int")).collect()
    assert len(rows) == 11 and {r.n_words for r in rows if r.doc_id == 5} == {18000}


def test_rule_learner_finds_planted_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 5] <= 0.5) | (x[:, 1] > 0.95)
    found = rules.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in found:
        hit |= r.covers(x)
    assert (hit == bad).mean() > 0.98
    assert rules.learn(x, np.zeros(len(x), bool)) == []


# --- classifier


def test_classifier(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classifier.classify(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.93 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    none = classifier.classify(spark, odd, labels.limit(0)).collect()
    assert len(none) == 11 and {r.score for r in none} == {0.5}


def test_classifier_scores_do_not_depend_on_neighbours():
    model = np.random.default_rng(1).random(classifier.SLOTS + 1).astype(np.float32)
    some = ["", "a", "Some text, twice twice.", "été " * 50, " lead", "\n"]
    together = classifier.score(some, model)
    assert all(abs(classifier.score([t], model)[0] - s) < 1e-9 for t, s in zip(some, together))


# --- line dedup


def deleted(texts, least):
    """Lines covered by a run of `least` words that starts earlier in another place."""
    lines = {d: t.split("\n") for d, t in texts.items()}
    seen, out = {}, defaultdict(set)
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                run = tuple(lines[d][i:j])
                if sum(len(re.findall(SPACES, x)) for x in run) >= least and seen.setdefault(run, (d, i)) != (d, i):
                    out[d] |= set(range(i, j))
    return {d: "\n".join(x for k, x in enumerate(ls) if k not in out[d]) for d, ls in lines.items()}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [prose(rng, rng.randint(0, 7)) for _ in range(9)]
    texts = {d: "\n".join(rng.choice(pool) if rng.random() < 0.93 else f"only {d} {rng.random()}" for _ in range(rng.randint(1, 16))) for d in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for least in (1, 12, 25):
        got = {r.doc_id: r.text for r in linedup.dedup_lines(spark, frame, min_words=least).collect()}
        assert got == deleted(texts, least)


def test_line_dedup_odd_rows(spark, odd):
    for least, tail in ((1, " tail"), (50, " tail")):
        got = linedup.dedup_lines(spark, odd, count_col="cut", long_col="long", min_words=least).collect()
        assert odd.columns + ["cut", "long"] == list(got[0].asDict())
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r.text)
        assert by[1] == [None] and by[2] == [""] and by[5] == ["", ""] and len(by[4][0]) > 1000 and by[6][0].endswith(tail) and by[8] == ["One TWO"]
        assert {r.cut for r in got if r.doc_id == 5} == {300} == {r.long for r in got if r.doc_id == 5}
    assert linedup.dedup_lines(spark, odd.limit(0)).count() == 0


def test_line_dedup_of_text_ids_and_private_names(spark):
    line = "one two three"
    rows = [("b", f"{line}\nx y"), ("a", f"{line}\n\nz"), (None, f"{line}\nq"), ("c", None), ("c", line), ("c", line)]
    names = ["_gone", "gone", "n_gone", "_k", "_d", "line", "words", "_row", "least", "m", "_id", "_text"]
    frame = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], f"doc_id string, text string, {', '.join(f'`{n}` int' for n in names)}")
    got = linedup.dedup_lines(spark, frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or "", r.text) for r in got.collect() if r.text is not None) == [("", f"{line}\nq"), ("a", "\nz"), ("b", "x y"), ("c", ""), ("c", "")]
    assert got.where("doc_id = 'c' and text is null").count() == 1 and got.agg(F.sum("`least`")).first()[0] == 8 * 6
    huge = spark.createDataFrame([(-(1 << 62), line), (None, line)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in linedup.dedup_lines(spark, huge).collect()) == [(-(1 << 62), ""), (0, line)]


# --- near duplicates


def shingles(text):
    w = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(texts):
    """What near_duplicates has to return, by comparing all pairs."""
    sets = {d: shingles(t or "") for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in (x for x in texts if x < a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in texts}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    texts, k = {}, 0
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[k] = " ".join(copy)
            k += 1
    hot = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # a group around the threshold, linked only in part
        copy = list(hot)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(120)] = rng.choice(words)
        texts[k] = " ".join(copy)
        k += 1
    texts |= {k: None, k + 1: "", k + 2: "same few", k + 3: "SAME few"}
    got = neardup.near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(texts)


def test_near_duplicates_hot_group(spark):
    """Copies of one text with none to nine words replaced: many share buckets, few links cross components."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = {}
    for k in range(150):
        copy = list(base)
        for _ in range(k % 10):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(60)}"
        texts[k] = " ".join(copy)
    got = neardup.near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked(texts)


def test_near_duplicates_odd_rows(spark, odd):
    rows = neardup.near_duplicates(spark, odd).collect()
    assert len(rows) == 11
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {
        (1, 1, True), (2, 2, True), (None, None, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 4, False), (7, 7, True), (8, 7, False),
    }
    assert neardup.near_duplicates(spark, odd.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(spark, odd)
    assert kept.columns == odd.columns and kept.count() == 7


def test_drop_near_duplicates_keeps_one_row_a_group(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(4))
    rows = [(4, a, "y"), (4, a, "x"), (5, a + " z", "x"), (5, b, "x"), (5, b, "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (None, c + " z", "x"), (6, d, "x"), (7, "", "x"), (7, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    kept = neardup.drop_near_duplicates(spark, frame)
    assert kept.columns == frame.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(r[0] for r in got if r[0] is not None) == [4, 5, 6, 7, 7] and sum(r[0] is None for r in got) == 1
    assert {(5, b, "x"), (6, d, "x")} <= set(got) and all(r[1] in (c, c + " z") for r in got if r[0] is None)
    assert neardup.drop_near_duplicates(spark, frame.select("doc_id", "text")).count() == 6


def test_near_duplicates_with_private_names_and_ids_of_several_texts(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(3))
    names = ["_gone", "_row", "row", "mark", "_row_key", "_key", "node", "own", "n", "kept", "_id", "_text"]
    rows = [("x", a), ("y", a + " z"), ("x", b), ("z", b + " q"), ("v", c)]
    frame = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], f"doc_id string, text string, {', '.join(f'`{n}` int' for n in names)}")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(spark, frame).collect()}
    assert got == {("x", 76): "x", ("y", 77): "x", ("z", 77): "x", ("v", 76): "v"}
    kept = neardup.drop_near_duplicates(spark, frame)
    assert kept.columns == frame.columns and sorted(r.text for r in kept.collect()) == sorted([a, b, c])


def test_classifier_learns_a_repeated_document_once(spark):
    rows = [(k, ("good words here " if k % 2 else "bad junk there ") * (k + 1)) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    hot = frame.union(frame.where("doc_id = 0").crossJoin(spark.range(200)).select("doc_id", "text"))
    once, more = (classifier.fit(spark, docs, marks, sample=30) for docs in (frame, hot))
    assert once.any() and (once == more).all()


# --- decontamination


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_match_alignment_everywhere(spark):
    rng = random.Random(2)
    items = {k: prose(rng, 25) + f" {k}" for k in range(6)}
    rows = []
    for d in range(60):
        text = prose(rng, 30)
        if d % 3 == 0:
            piece = list(items[d % 6])
            for _ in range(rng.randint(0, 14)):
                piece[rng.randrange(len(piece))] = rng.choice(["", "z", "qq"])
            text += " " + "".join(piece) + " " + prose(rng, 5)
        rows.append((d, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, frame, marks).collect()}
    want = {
        (d, i) for d, t in rows for i, x in items.items()
        if distance(decontaminate.normal(x), decontaminate.normal(t)) <= int(len(decontaminate.normal(x)) * decontaminate.EDIT_SHARE)
    }
    assert got == want and len(want) > 8
    clean = decontaminate.decontaminate(spark, frame, marks)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leaks_of_short_items():
    """Items of 1 to 39 characters, exact and with all edits of their budget, evenly spread."""
    rng = random.Random(9)
    for n in range(1, 40):
        item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        budget = int(n * decontaminate.EDIT_SHARE)
        index = decontaminate.Index.of([("x", item), ("none", None)], decontaminate.EDIT_SHARE)
        assert (index.need >= 1).all()
        places = [(k + 1) * n // (budget + 1) for k in range(budget)]
        near = "".join("#" if k in places else c for k, c in enumerate(item))
        assert len(places) == sum(c == "#" for c in near) == budget
        found = index.find(f"0123 {item} 4567 {near} 89")
        assert [(m[0], m[1], m[3]) for m in found] == [(0, 5, 0), (0, 5 + n + 6, budget)], (n, found)
    index = decontaminate.Index.of([("x", "aa")], decontaminate.EDIT_SHARE)
    assert [m[1] for m in index.find("aaaaa b aa")] == [0, 2, 8]


def test_leaks_odd_rows(spark, odd):
    marks = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "item_id long, text string")
    assert decontaminate.find_leaks(spark, odd, marks).count() == 0
    assert decontaminate.decontaminate(spark, odd, marks).count() == 11
    assert decontaminate.find_leaks(spark, odd, marks.limit(0)).count() == 0


# --- packing


def check_bins(rows, capacity=2048):
    """Pieces are gapless; but for a partition's last two sequences, a sequence is one whole block, or
    the end of a document (k pieces of class k), then what other documents give to fill it."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.start, r.doc_tokens))
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
    last = {q >> 36: max(x for x in sequences if x >> 36 == q >> 36) for q in sequences}
    merged = set()
    for q, parts in sequences.items():
        at = 0
        for offset, length, _, _ in sorted(parts):
            assert offset == at and length
            at += length
        assert at == capacity or q == last[q >> 36] and at < capacity
        k = capacity // sorted(parts)[0][1]
        first = sorted(parts)[:k]
        if not (len(first) == k and all(capacity // n == k and (k == 1 and n == capacity or start + n == total) for _, n, start, total in first)):
            merged.add(q)
    return merged, sequences


def test_packing(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer())
    ids = {d: np.array(model.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    rows = packing.pack(docs, queries.tokenizer()).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert {r.doc_id for r in rows} == set(ids)
    check_bins(rows)
    assert len(rows) < 2.2 * len(ids)
    rows = packing.pack(odd, queries.tokenizer()).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and packing.pack(odd.limit(0), queries.tokenizer()).count() == 0
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5)


def test_bins_hold_k_pieces_of_class_k():
    """Random lengths through the bins of one partition, each class recomputed from the rows."""
    from collections import namedtuple

    row = namedtuple("row", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    rng = random.Random(8)
    for lengths in ([rng.choice([1, 2, 3, 300, 700, 1025, 2048, 2049, rng.randint(1, 9000)]) for _ in range(3000)], [1500] * 50, [1], [2048] * 3, [683] * 10):
        bins = packing.Bins(0, 2048)
        rows = [row(*r) for d, n in enumerate(lengths) for r in bins.put(d, bytes(4 * n))]
        closed = len({r.sequence_id for r in rows})
        rows += [row(*r) for r in bins.rest()]
        merged, sequences = check_bins(rows)
        assert all(q >= closed for q in merged), "only what the end of a partition merges has no class"
        assert sum(r.length for r in rows) == sum(lengths) and len(sequences) == -(-sum(lengths) // 2048)
        open_tokens = sum(lengths) - closed * 2048
        assert open_tokens < 2048 * len({2048 // max(1, n % 2048) for n in lengths}) + 2048 * 90


def test_remembered_words_equal_whole_texts(monkeypatch):
    import pyarrow as pa

    some = ["It's a TEST\u2014. don't'\u0301 <|endoftext|> x", "\u00dcn\u00ef\u0308 co\u200bde ,,, a.b.c  .'s 're!'", "", "\x85\xa0 a b \u03a3\u0391\u03a3. \u0130stanbul", "<|x a", "x" * 3000, " lead and end ", "a\U0001f602b \U0001f602 c"]
    for step, remembered in ((100_000, 500_000), (3, 2)):
        monkeypatch.setattr(packing, "STEP_WORDS", step)
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        tokens = packing.Tokens(queries.tokenizer())
        for texts in (some, some[::-1], [], [""], some):
            assert [list(i) for i in tokens.ids(pa.array(texts, pa.string()))] == [tokens.model.encode(t, add_special_tokens=False).ids + [1] for t in texts]


# --- language model


def test_context_tree_weighting_matches_plain_recursion(spark):
    rng = random.Random(4)
    rows = [(d, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))) for d in range(12)] + [(20, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score_texts(spark, frame).collect()}
    depth = ctw.DEPTH
    train = [(t or "").encode() for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = defaultdict(lambda: [0, 0])

    def steps(raw):
        data = bytes(depth) + raw + b"\0"
        for i in range(depth, len(data)):
            for b in range(8):
                yield data[i - depth : i], (256 | data[i]) >> (8 - b), data[i] >> (7 - b) & 1

    for raw in train:
        for context, node, bit in steps(raw):
            for k in range(depth + 1):
                counts[context[depth - k :], node][bit] += 1
    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)

    def log_kt(key):
        z, o = counts[key]
        return float(ctw.log_kt(np.array(float(z)), np.array(float(o))))

    memory = {}

    def weighted(key):
        if key not in memory:
            below = sum(weighted((c, key[1])) for c in children[key])
            memory[key] = log_kt(key) if len(key[0]) == depth else np.logaddexp(log_kt(key), below) - np.log(2), below
        return memory[key][0]

    def chance(context, node, bit, k):
        key = (context[depth - k :], node)
        z, o = counts[key] if key in counts else (0, 0)
        kt = ((o if bit else z) + 0.5) / (z + o + 1)
        if k == depth or key not in counts or (context[depth - k - 1 :], node) not in counts:
            return kt
        weighted(key)
        share = np.exp(log_kt(key) - np.logaddexp(log_kt(key), memory[key][1]))
        return share * kt + (1 - share) * chance(context, node, bit, k + 1)

    words = Counter(w for raw in train for w in [*raw.split(), None])
    total = sum(words.values())
    for d, t in rows:
        raw = (t or "").encode()
        want = sum(np.log10(chance(c, n, b, 0)) for c, n, b in steps(raw))
        tokens = [*raw.split(), None]
        assert got[d].score == pytest.approx(want, abs=1e-4)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), total)
        assert got[d].base_score == pytest.approx(sum(np.log10((words[w] + 0.5) / (total + 0.5 * (len(words) + 1))) for w in tokens), abs=1e-6)


def test_language_model_odd_rows(spark, odd):
    rows = ctw.score_texts(spark, odd).collect()
    assert len(rows) == 11 and all(r.score < 0 for r in rows)
    assert ctw.score_texts(spark, odd.limit(0)).count() == 0


# --- chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", r"<\|im_end|> [\\INST] \n", None, "", "plain <b> [x] é\n\n", "<<SYS>>a<</SYS>>", "<\\\\|im_end|>"]
    rows = [(c, n, ["system", "user", "assistant", None, "a\nb\\n"][(c + n) % 5], texts[(c * 3 + n) % len(texts)]) for c in range(20) for n in range(c % 6 + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(frame)
    for r in done.collect():
        assert r.formatted.count("<|im_start|>") == r.conv_id % 6 + 1 and "[INST]" not in r.formatted and "</s>" not in r.formatted
    for r in chat.digests(done, "conv_id").collect():
        turns = [(role or "", text or "") for c, n, role, text in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"prompt": "p", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")]),
        ('{"completion": null, "prompt": "p"}', "prompt", [("user", "p"), ("assistant", "")]),
        ('{"instruction": "i", "input": "", "output": "o"}', "alpaca", [("user", "i"), ("assistant", "o")]),
        ('{"instruction": "i", "input": "n", "output": "o"}', "alpaca", [("user", "i\n\nn"), ("assistant", "o")]),
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        ('{"other": 1}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    got = chat.to_turns(spark.createDataFrame([(k, r[0]) for k, r in enumerate(records)], "k int, record string"), "record").orderBy("k").collect()
    for r, (_, name, turns) in zip(got, records):
        assert r.layout == name and (r.turns is None if turns is None else [tuple(t) for t in r.turns] == turns)


def test_chat_large_texts(spark):
    """One text over 20 M characters, a conversation over 128 MiB, and JSON records of these."""
    unit, long = 'abcde fgh \\ "\n', 1_500_000
    rows = spark.range(8).selectExpr("if(id = 0, 1, 2) as conv_id", "id as turn", "if(id % 2 = 0, 'assistant', 'user') as role").withColumn("text", F.repeat(F.lit(unit), long))
    done = chat.format_conversations(rows).select("conv_id", "loss_mask", F.sha2("formatted", 256).alias("sha256"))
    got = {r.conv_id: r for r in done.collect()}
    for c, turns in ((1, [0]), (2, range(1, 8))):
        want, at, spans = hashlib.sha256(), 0, []
        for n in turns:
            role = "assistant" if n % 2 == 0 else "user"
            want.update(f"<|im_start|>{role}\n{unit * long}<|im_end|>\n".encode())
            begin = at + len(f"<|im_start|>{role}\n")
            at = begin + len(unit) * long + len("<|im_end|>\n")
            spans += [(begin, begin + len(unit) * long)] if role == "assistant" else []
        assert got[c].sha256 == want.hexdigest() and [tuple(s) for s in got[c].loss_mask] == spans
    text = F.col("text")
    two = F.struct(text.alias("prompt"), F.lit("c").alias("completion"))
    many = F.struct(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda _: F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"))
    one = rows.where("turn = 0")
    records = one.select(F.to_json(two).alias("r")).union(one.select(F.to_json(many))).union(one.select(F.concat(F.lit("not json "), "text")))
    read = chat.to_turns(records, "r").select("layout", F.transform("turns", lambda t: F.md5(t["text"])).alias("m")).collect()
    m = hashlib.md5((unit * long).encode()).hexdigest()
    assert [tuple(r) for r in read] == [("prompt", [m, hashlib.md5(b"c").hexdigest()]), ("messages", [m] * 7), (None, None)]
    large = spark.range(1).select(F.concat(F.lit('{"other": ['), F.repeat(F.lit("1.5, "), 14_000_000), F.lit("1.5]}")).alias("r"))
    assert chat.to_turns(large, "r").select("layout").collect()[0][0] is None


def test_chat_paths_and_names(spark):
    """Names with marks and spaces, mixed lists, objects in objects; columns with the names of results."""
    cases = {
        '{"a b": 1, "c,d:e": [{"x<y>": 1}, 2, "t", null, {"z": {"w": 1}}], "o": {"p": 1}, "l": ["{", 1.5]}': ["a b", "c,d:e", "c,d:e[].x<y>", "c,d:e[].z", "l", "o", "o.p"],
        '{"messages": [{"role": "user", "content": "[{"}, {"content": "b", "role": null}]}': ["messages", "messages[].content", "messages[].role"],
        "{}": [], "[1]": None, "x": None, '{"q\\"r": "\\\\"}': ['q"r'],
    }
    frame = spark.createDataFrame([(k,) for k in cases], "r string")
    got = {x.r: x.p for x in frame.select("r", chat.field_paths(chat.skeleton(F.col("r"))).alias("p")).collect()}
    assert got == cases
    names = ["_v", "_f", "_p", "row", "mark", "layout", "turns", "formatted", "loss_mask", "pieces"]
    one = spark.createDataFrame([('{"prompt": "p", "completion": "c"}', *range(len(names)))], f"r string, {', '.join(f'`{n}` int' for n in names)}")
    done = chat.format_turns(chat.to_turns(one, "r"))
    row = done.first()
    assert row["_v"] == 0 and row["mark"] == 4 and row.layout == "prompt" and row.formatted == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert sorted(done.columns) == sorted(["r", *names])


def test_chat_tables_by_fingerprint(spark):
    """The columns' fingerprint selects the mapping; an unknown table is an error."""
    pairs = spark.createDataFrame([(1, "p", None)], "id long, prompt string, response string")
    assert [tuple(t) for t in chat.table_turns(pairs, ("id",)).first().turns] == [("user", "p"), ("assistant", "")]
    lists = spark.createDataFrame([(1, [("user", "a"), (None, "b")])], "id long, messages array<struct<role: string, content: string>>")
    assert [tuple(t) for t in chat.table_turns(lists, ("id",)).first().turns] == [("user", "a"), ("", "b")]
    turns = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", "a")], "id long, turn int, role string, text string")
    assert [t.text for t in chat.table_turns(turns, ("id",)).first().turns] == ["a", "b"]
    with pytest.raises(ValueError, match="no layout"):
        chat.table_turns(pairs.withColumnRenamed("prompt", "unknown"), ("id",))


# --- html


def test_html_article():
    page = """<!DOCTYPE html><html><head><title>no</title><script>if (a<b) "</p>"</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie notice">We use cookies</div>
    <div id=wrap><article><h1>Head&amp;line</h1><p><b>First   para&#233;<br>more<p>Second <a href="y">link</a> text, long enough.</p>
    <aside>side</aside><form><input></form><ul><li>one<li>two</ul><div class="comments"><p>reader says</p></div></article></div>
    <div class="ad">Buy</div><footer>&copy; x</footer>"""
    assert html.main_text(page) == "Head&line\nFirst paraé more\nSecond link text, long enough.\none\ntwo"
    words = "Plain words that go on for a while, with no link at all in them. " * 4
    page = f"<body><div class=menu><a href=1>a</a> <a href=2>b</a></div><div class=content><h2>T</h2><p>{words}</p><p>{words}</p></div><div class=sidebar>s</div></body>"
    assert html.main_text(page).split("\n")[-2:] == [words.strip()] * 2
    for broken in ("", "<", "<p", "</", "<!--", "<a b='", "text only", "<script>", "</p></div>", "<" * 50, "&#xZZ;&bogus;"):
        html.main_text(broken)


def test_html_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<p>a</p>"), (4, "u", "<p>a&nbsp; b</p>"), (4, "u", "<p>a&nbsp; b</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "a", 1), (1, "", 0), (2, "", 0), (4, "a b", 3), (4, "a b", 3)]


# --- all together


def test_queries_and_pipeline_run(spark):
    import corpus_pipeline

    for name, query in queries.queries().items():
        assert query(spark, SF).count() >= 0, name
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_leaks_in_long_runs_of_one_character():
    """Grams that are frequent on both sides are counted in steps, with the same result."""
    tail = " the quick brown fox jumps over the lazy dog and then it sleeps"
    index = decontaminate.Index.of([("x", "-" * 300 + tail)], decontaminate.EDIT_SHARE)
    assert [m[1:] for m in index.find("start " + "-" * 30_000 + tail + " more")] == [(6 + 29_700, 6 + 30_000 + len(tail), 0)]
    assert index.find("-" * 30_000 + " something else at the end of the run, as it goes on and on") == []


def test_classifier_features_and_scores_match_a_plain_computation():
    """Every gram and word hashed one at a time, scores as plain averages."""

    def slots(text):
        raw = text.encode().lower() + bytes(4)
        out = []
        for i in range(len(raw) - 3):
            three = int.from_bytes(raw[i : i + 3], "little")
            out += [(three * 2654435761 % 2**32) >> 14, (int.from_bytes(raw[i : i + 4], "little") * 2246822519 % 2**32) >> 14]
        for word in re.findall(rb"[^\x00\x20\x09-\x0d]+", raw):
            h = sum(c * pow(16777619, k, 2**32) for k, c in enumerate(word)) % 2**32
            out.append((h * 3266489917 % 2**32) >> 14)
        return out

    some = ["", "a", "Some Text, twice twice.", "été\tÜber 12 \n x", " lead", "\n", "word " * 300]
    got, start = classifier.features(some)
    ends = [*start[1:], len(got)]
    model = np.random.default_rng(2).normal(size=classifier.SLOTS + 1).astype(np.float32)
    for text, a, z, score in zip(some, start, ends, classifier.score(some, model)):
        want = slots(text)
        assert sorted(got[a:z].tolist()) == sorted(want), text
        assert score == pytest.approx(1 / (1 + np.exp(-(np.mean(model[want].astype(float)) + model[-1]))), abs=1e-6)
