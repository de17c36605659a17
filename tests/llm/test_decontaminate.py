"""Banded alignment, matches and counts against a plain search; long items; hostile texts for anchors."""

import random
import time

import numpy as np
import pytest

from threatlake.llm import decontaminate, packing, pii


def plain(item, text):
    """Least edits of the whole item against any part of a text, latest start, first end."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for c in item:
        new = [(row[0][0] + 1, row[0][1])]
        for j, t in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != t), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j], j))
    return row[end][0], -row[end][1], end


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(1, max(2, len(out) - 1)), rng.randrange(3)
        out[at : at + 1] = [] if kind == 0 else ["#"] if kind == 1 else [out[at], "+"]
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_band_equals_the_whole_matrix():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(5, 60)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))
        at = rng.randint(0, len(text))
        text = text[:at] + edited(rng, item, rng.randint(0, 4)) + text[at:]
        want = plain(item, text)
        for budget in (1, 3, 6):
            got = decontaminate.banded(decontaminate.points(item), decontaminate.points(text), -len(item), len(text), budget)
            assert got == (want if want[0] <= budget else None)


def test_matches_apart_are_all_found():
    rng = random.Random(2)
    item = prose(rng, 25)
    index = decontaminate.Index.of([(7, item)], 0.08)
    for gap in range(0, 140, 7):
        copies = [edited(rng, item, 3), edited(rng, item, 2), item]
        text = prose(rng, 10) + " " + (" " + "z" * gap + " ").join(copies) + " " + prose(rng, 5)
        got = index.find(text)
        assert len(got) == 3 and all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        for (_, start, end, edits), copy in zip(got, copies):
            assert plain(item, decontaminate.normal(text)[start:end])[0] == edits <= plain(item, copy)[0]
            assert abs(start - decontaminate.normal(text).index(copy)) <= 6


def test_many_items_against_a_plain_search():
    rng = random.Random(3)
    items = [prose(rng, n) for n in (3, 6, 12, 20, 30)]
    index = decontaminate.Index.of(list(enumerate(items)), 0.08)
    for _ in range(40):
        held = [rng.randrange(5) for _ in range(rng.randint(0, 3))]
        text = prose(rng, 15) + " ".join(" " + edited(rng, items[i], rng.randint(0, max(0, int(len(items[i]) * 0.07)))) + " " + prose(rng, 4) for i in held)
        got = index.find(text)
        whole = decontaminate.normal(text)
        for i, item in enumerate(items):
            mine = [m for m in got if m[0] == i]
            assert bool(mine) == (plain(item, whole)[0] <= int(len(item) * 0.08))
            assert len(mine) >= held.count(i) or len(item) * 0.08 < 1
            assert all(plain(item, whole[s:e])[0] == d for _, s, e, d in mine)


@pytest.mark.parametrize("size", [20_000, 100_000])
def test_long_items(size):
    rng = random.Random(4)
    item = prose(rng, size // 5)[:size].strip()
    index = decontaminate.Index.of([(1, item), (2, "short one here and there")], 0.08)
    text = "before " + edited(rng, item, 40) + " after short one here and there"
    began = time.perf_counter()
    got = index.find(text)
    assert [m[0] for m in got] == [0, 1] and got[0][3] <= 40 and got[0][1] == 7
    assert time.perf_counter() - began < 4


def test_an_item_beyond_two_million_characters():
    item = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 2_300_000)))
    index = decontaminate.Index.of([(1, item), (2, item[::-1][:300])], 0.0)
    assert index.find("x" + item + "y" + item[::-1][:300]) == [(0, 1, 2_300_001, 0), (1, 2_300_002, 2_300_302, 0)]


def test_anchors_take_linear_time():
    for text in ("1://" * 250_000, "://" * 300_000, "a://" * 250_000, "@" * 1_000_000, "a@" * 500_000, "1." * 500_000, "+1" * 500_000, '="' * 500_000, "IBAN " * 200_000, "SSN" * 300_000, "1" * 1_000_000, "1 " * 500_000):
        began = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - began < 8, text[:8]


def test_open_tails_keep_their_own_ids():
    bins, rows = packing.Bins(0, 2048), []
    for doc in range(300):
        rows += list(bins.put(doc, np.arange(2048 * 3 + doc * 7 % 900 + 1, dtype=np.uint32).tobytes()))
    held = sum(len(p[2]) for ps in bins.open.values() for p in ps) + sum(len(p[2]) for _, ps in bins.short for p in ps)
    assert held <= 4 * 2048 * (len(bins.open) + len(bins.short))
    rows += list(bins.rest())
    assert sum(r[2] for r in rows) == sum(2048 * 3 + doc * 7 % 900 + 1 for doc in range(300))


def test_personal_data_of_odd_rows(spark):
    long = "x " * 300_000 + "a@b.co"
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, long)]
    odd = spark.createDataFrame([(i, t, 9, "s", "t") for i, t in rows], "doc_id long, text string, _id int, spans string, _text string")
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.find_pii(odd).collect()), key=repr)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (None, 1, "email:0:6"), (3, 1, "email:0:6"), (3, 1, "email:0:6"), (4, 1, "email:600000:600006")], key=repr)
    assert pii.find_pii(odd.limit(0)).count() == 0
