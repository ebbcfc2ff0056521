"""Near-duplicates, repeated strings and lines against plain versions."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.llm import line_dedup, minhash, suffix_dedup
from pairforge.llm.common import BATCH_ROWS, TEXT_ROWS, Workspace, arrow_map, arrow_schema, components, text_batches


def removed(texts, length):
    """Maximal runs of bytes in strings that start in two places, for each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for g, _ in itertools.groupby(gone) if g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def as_rows(rows):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def test_op2(query, docs):
    rows = docs.collect()
    wanted = removed([r.text for r in rows], 200)
    assert as_rows(query(2).collect()) == sorted((str(r.doc_id), *w) for r, w in zip(rows, wanted))
    assert any(w[1] for w in wanted) and any(not w[1] for w in wanted)


@pytest.mark.parametrize("length, seed, group", [(40, 8, 2048), (40, 8, 1), (64, 64, 2048), (200, 32, 2048)])
def test_repeats_in_small_texts(spark, monkeypatch, length, seed, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    body = "abcdefghij klmnop qrstuv wxyz 0123456789 " * 3
    texts = [
        "a" * 500, "ab" * 300, body, "x" + body[:90] + "y", body[5:] + "é" * 60, "q" * length, "q" * (length - 1),
        body[:70] + "zz" + body[:70], None, "", "z" + body[10:100], "Z" + body[20:110],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = as_rows(suffix_dedup.remove_repeats(df, length, seed).collect())
    assert found == sorted((str(i), *w) for i, w in enumerate(removed(texts, length)))


def test_buffers_cut_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    suffix_dedup._tables.cache_clear()
    texts = [("ab%dcd" * 200) % tuple(range(200)), "k" * 1000, "short"]
    raws = [t.encode() for t in texts]
    starts = set()
    for data, room, parts in suffix_dedup.buffers(raws, 50):
        _, lo, hi, _ = suffix_dedup.anchors(data, room, 50, 16)
        for a, b in zip(lo, hi):
            owner, base, at = [p for p in parts if p[1] <= a][-1]
            starts |= {(owner, at + p - base) for p in range(a, b + 1)}
    wanted = {(i, p) for i, r in enumerate(raws) for p in range(len(r) - 49)}
    suffix_dedup._tables.cache_clear()
    assert starts == wanted


def scanned(ranges, size):
    """What scans of ranges of ``(key, new, place)`` report, their ends settled as the family does."""
    sure, counts, left = [], {}, []
    kinds = arrow_schema(suffix_dedup.FOUND)
    for rows in ranges:
        scan = suffix_dedup.MergeScan(kinds)
        out = []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            columns = {"key": [b"%03d" % k for k, _, _ in part], "new": [n for _, n, _ in part]}
            columns |= {"ext": [0] * len(part), "doc": [0] * len(part), "place": [p for _, _, p in part]}
            out += scan.step(pa.RecordBatch.from_pydict(columns))
        for r in [r for batch in [*out, *scan.close(True)] for r in batch.to_pylist()]:
            if r["kind"] == suffix_dedup.SURE:
                sure.append(r["place"])
            elif r["kind"] == suffix_dedup.COUNTS:
                old, new = counts.get(r["key"], (0, 0))
                counts[r["key"]] = (old + r["old"], new + r["new"])
            else:
                left.append(r)
    for r in left:
        old, new = counts[r["key"]]
        if (r["old"] and old == 1 and new) or (r["new"] and old + new > 1):
            sure.append(r["place"])
    return sorted(sure)


@pytest.mark.parametrize("seed", range(60))
def test_merge_scan_reports_each_suffix_once(spark, seed):
    rng = random.Random(seed)
    rows = sorted((rng.choice([0, rng.randrange(1, 12)]), rng.randrange(2), p) for p in range(rng.randrange(1, 60)))
    old, new = Counter(k for k, n, _ in rows if not n), Counter(k for k, n, _ in rows if n)
    wanted = [p for k, n, p in rows if (old[k] + new[k] > 1 if n else old[k] == 1 and new[k])]
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))
    ranges = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    assert scanned(ranges, rng.choice([1, 2, 5, 100])) == sorted(wanted)


def test_levels_merge_geometrically(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(40))
    with Workspace(spark) as ws:
        family = suffix_dedup.SuffixFamily(ws, 40, 40)
        sizes, found = [], []
        for b in range(5):
            rows = [(10 * b + i, t.encode()) for i, t in enumerate([text, text[::-1][: 39 - b] + "0123456789"])]
            family.add(spark.createDataFrame(rows, "doc bigint, raw binary"))
            sizes.append([n for n, _ in family.levels])
            found.append({r.doc for r in family.found().select("doc").distinct().collect()} & set(range(0, 50, 10)))
        assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
        assert found == [set(), {0, 10}, {0, 10, 20}, {0, 10, 20, 30}, {0, 10, 20, 30, 40}]
        assert family.found().count() == family.found().distinct().count()
        for _, name in family.levels:
            keys = [bytes(r.key) for r in family.level(name).collect()]
            assert len(keys) == family.level(name).count() and all(len(k) == 40 for k in keys)


def test_a_later_call_adds_a_batch(spark, docs, tmp_path):
    """Levels in a folder; a second workspace adds a batch, and all repeats are those of one go."""
    rows = docs.orderBy("doc_id").collect()
    half = len(rows) // 2
    folder = str(tmp_path / "family")
    whole = suffix_dedup._documents(docs)
    for again, side in ((False, F.col("doc_id") <= rows[half].doc_id), (True, F.col("doc_id") > rows[half].doc_id)):
        with Workspace(spark) as ws:
            family = suffix_dedup.SuffixFamily(ws, folder=folder, again=again)
            family.add(whole.where(side).select("doc", "raw"))
            sizes = [n for n, _ in family.levels]
            runs = suffix_dedup.repeats_of(docs, family.found(), ws)
            found = {r.doc_id: r.runs for r in runs.join(whole, "doc").collect()}
    assert sizes == [2]
    level = [bytes(r.key) for r in family.level(family.levels[0][1]).collect()]
    assert len(level) > 100 and sum(a > b for a, b in zip(level, level[1:])) < 32
    wanted = removed([r.text for r in rows], 200)
    for r, w in zip(rows, wanted):
        own = np.array([tuple(x) for x in found.get(r.doc_id, [])], dtype=np.int64).reshape(-1, 2)
        covered = 0
        if len(own):
            a, b = suffix_dedup.spans(own[:, 0], own[:, 1], 200)
            covered = int((b - a).sum())
        assert covered == w[1]


def test_odd_rows_lose_only_what_repeats(odd, no_docs):
    rows = odd.collect()
    found = suffix_dedup.remove_repeats(odd).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[8].n_removed == by_id[8].n_bytes and by_id[9].n_removed == by_id[9].n_bytes - len(" end")
    assert by_id[3].n_bytes == by_id[4].n_bytes == 0 and by_id[1].n_removed == 0
    assert by_id[11].n_spans == 1 and by_id[10].n_removed == 600
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns
    texts = {r.doc_id: r for r in left.collect()}
    assert 8 not in texts and 10 not in texts and texts[9].text == " end"
    assert texts[11].text == "x début" and texts[11].n_chars == 7 and texts[3].text is None
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def groups(sets, percent):
    """Smallest id reachable over links between sets."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, query, k):
    sets = {r.doc_id: shingles(r.text, k) for r in docs.collect()}
    wanted = groups(sets, 80)
    found = (query(5) if k == 2 else minhash.near_duplicates(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        i: (len(s), wanted[i], wanted[i] == i) for i, s in sets.items()
    }
    assert any(not r.kept for r in found)


def test_large_groups_of_copies(spark):
    """Hundreds of different near copies, and a chain that no hub sees whole."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[i % 118 + 1] = f"x{i}"
        rows.append(" ".join(words))
    chain = [" ".join(f"c{j}" for j in range(3 * i, 3 * i + 100)) for i in range(40)]
    rows += chain + ["w1 w2 w3 another thing"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=2).collect()}
    assert found == groups({i: shingles(t, 2) for i, t in enumerate(rows)}, 80)


@pytest.mark.parametrize("setting", [{"CLOSE": 0.0, "LEAF": 64}, {"LEAF": 2, "BLOCK": 400}, {"LEAF": 2, "SKETCH": 0.0}])
def test_wrong_sketches_lose_no_link(spark, monkeypatch, setting):
    """All members of small nodes stand for each other though most are not close; every node large."""
    for name, value in setting.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(4)
    rows = []
    for i in range(60):  # a chain of near copies and a crowd of two thirds
        rows.append(" ".join(f"c{j}" for j in range(4 * i, 4 * i + 90)))
        rows.append(" ".join(f"s{j}" if rng.random() < 0.9 else f"r{i}x{j}" for j in range(80)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=1).collect()}
    assert found == groups({i: shingles(t, 1) for i, t in enumerate(rows)}, 80)


def test_odd_rows_near(odd, no_docs):
    found = minhash.near_duplicates(odd, k=5).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[9].component_id == 8
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (3, 4, 5))
    assert by_id[6].n_shingles == 1
    left = minhash.one_of_each(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 9 not in ids and ids.count(None) == 2
    assert ids.count(12) == 1  # the other text of this number is close to that of 11
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    with Workspace(spark) as ws:
        rows = components(ws, spark.createDataFrame(path + star + [(5000, 5000)], "a bigint, b bigint")).collect()
        assert {r.node: r.root for r in rows} == {
            **{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}
        }
        assert components(ws, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_lines(texts):
    """Numbers of the lines to drop in each text: the whole rule in plain Python."""
    docs = []  # of each text: (number, masked line, leaf, leaf before, leaf after, tokens)
    for text in texts:
        found = [(i, line_dedup.masked(x)) for i, x in enumerate((text or "").split("\n"))]
        found = [(i, t) for i, t in found if t]
        leaves = [0, *((len(t), *t[: line_dedup.LEADING]) for _, t in found), 0]
        docs.append([(i, " ".join(t), leaves[k + 1], leaves[k], leaves[k + 2], t) for k, (i, t) in enumerate(found)])

    def once(rows):
        """Of ``(key, document, number, before, after)`` the first number in each document."""
        first = {}
        for key, d, i, before, after in rows:
            if (key, d) not in first or i < first[key, d][0]:
                first[key, d] = (i, before, after)
        sides = {}
        for (key, _), (_, before, after) in first.items():
            sides.setdefault(key, []).append((before, after))
        return sides

    def varied(sides):
        def top(at, side):
            return max(Counter(x[side] for x in at).values())

        return {
            key for key, at in sides.items()
            if len(at) >= line_dedup.MIN_DOCS and min(top(at, 0), top(at, 1)) <= line_dedup.SAME_PLACE * len(at)
        }

    every = [(d, *x) for d, lines in enumerate(docs) for x in lines]
    sides = once((line, d, i, b, a) for d, i, line, _, b, a, _ in every)
    often = set()
    for _, _, line, _, _, _, t in every:
        n = len(sides[line])
        long, short = len(t) >= line_dedup.MIN_TOKENS, any(map(str.isalpha, line)) and n >= line_dedup.SHORT_DOCS
        if n >= line_dedup.MIN_DOCS and (long or short):
            often.add(line)
    exact = varied({x: sides[x] for x in often})

    rest = [x for x in every if len(x[6]) >= line_dedup.MIN_TOKENS and x[2] not in exact]
    size = Counter(x[3] for x in rest)
    rest = [x for x in rest if size[x[3]] >= line_dedup.MIN_DOCS]
    counts = Counter((x[3], p, t) for x in rest for p, t in enumerate(x[6]))
    formed = set()
    for d, i, _, leaf, b, a, tokens in rest:
        known = [(p, t, counts[leaf, p, t]) for p, t in enumerate(tokens)]
        known = [x for x in known if x[2] >= line_dedup.MIN_DOCS]
        levels = {(n // line_dedup.MIN_DOCS).bit_length() for _, _, n in known}
        forms = {tuple(x[:2] for x in known if (x[2] // line_dedup.MIN_DOCS).bit_length() >= at) for at in levels}
        forms.add(tuple(x[:2] for x in known if 2 * x[2] > size[leaf]))
        enough = max(line_dedup.CONSTANT * len(tokens), line_dedup.LEADING)
        formed |= {((leaf, form), d, i, b, a) for form in forms if len(form) >= enough}
    by_form = once(formed)
    formed = {x for x in formed if len(by_form[x[0]]) >= line_dedup.MIN_DOCS}
    by_form = once(formed)

    lines_of_often = {(x[2], x[0], x[1]) for x in every if x[2] in often}
    marked = {x[1:] for x in lines_of_often} | {x[1:3] for x in formed}
    outside = {}
    for d, lines in enumerate(docs):
        own = [x for x in lines if (d, x[0]) not in marked]
        if lines and len(own) / len(lines) >= line_dedup.OWN:
            for x in lines:
                if (d, x[0]) in marked:
                    before = [o[2] for o in own if o[0] < x[0]][-1:] or [0]
                    after = [o[2] for o in own if o[0] > x[0]][:1] or [0]
                    outside[d, x[0]] = (before[0], after[0])

    def recurring(found, near):
        far = once((key, d, i, *outside[d, i]) for key, d, i in found if (d, i) in outside)
        return varied(near) | varied(far) | {key for key, at in far.items() if len(set(at)) >= line_dedup.MIN_DOCS}

    lines = recurring(lines_of_often, {x: sides[x] for x in often})
    forms = recurring({x[:3] for x in formed}, by_form)
    dropped = [set() for _ in texts]
    for key, d, i in [x for x in lines_of_often if x[0] in lines] + [x[:3] for x in formed if x[0] in forms]:
        dropped[d].add(i)
    return dropped


def test_op10_equals_the_plain_rule(query, docs):
    rows = docs.collect()
    found = {r.doc_id: r for r in query(10).collect()}
    plain = plain_lines([r.text for r in rows])
    assert len(found) == len(rows) and any(plain)
    for r, lines in zip(rows, plain):
        own = found[r.doc_id]
        assert (own.n_lines, own.n_dropped) == (r.text.count("\n") + 1 if r.text else 0, len(lines)), r.doc_id
        kept = "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if i not in lines)
        assert own.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_forms_and_short_lines_equal_the_plain_rule(spark):
    """Word fields, rival forms in a leaf, short lines, headers, copies, near copies, digits, scripts without spaces."""
    texts = []
    for i in range(60):
        lines = [words(i, k, 3 + k) for k in range(3)]
        lines.insert(i % 3, f"Written by {words(i, 9, 1)} for all of you")
        lines.insert(i % 4, f"Written by {words(i, 8, 1)} for nobody at all" if i % 2 else f"Item {i} of 60 shown")
        lines += ["Read more"] * (i % 3 == 0) + ["Log"] * (i % 5 == 0) + ["-- --"] + ["", "版权所有"] * (i % 2)
        texts.append("\n".join([*HEADER[: i % 4], *lines, *FOOTER[: i % 3]]))
    texts += [texts[0]] * 30 + ["\n".join([words(500, k) for k in range(9)] + [words(600 + i, 0)]) for i in range(20)]
    texts += [None, "", "\n\n", "Read more", HEADER[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    plain = plain_lines(texts)
    assert sum(map(len, plain)) > 100
    for i, (text, lines) in enumerate(zip(texts, plain)):
        kept = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in lines)
        assert (found[i].n_dropped, found[i].text) == (len(lines), kept), i


def test_templates_with_fields(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26) + "na"
    rows = []
    for i in range(30):
        own = [f"{name(i + 31 * k)} {name(2 * i + k)} alone here {name(i)}" for k in range(3)]
        shared = [f"Posted by user{i} in group {i}", f"Share this page on {name(i)} now dear"]
        rows.append("\n".join([own[0], shared[0], own[1], shared[1], own[2]]))
    copies = ["same first line here\nsame second line here\nsame third line here"] * 20
    df = spark.createDataFrame(list(enumerate(rows + copies)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    for i in range(30):
        assert found[i].n_dropped == 2 and "Posted" not in found[i].text and "Share" not in found[i].text
    assert all(found[30 + i].n_dropped == 0 for i in range(20))


def words(i, k, n=5):
    """A line of its own: words that no other line has at this place."""
    name = lambda j: "".join(chr(97 + j // 26**p % 26) for p in range(4))
    return " ".join(name(7919 * (i + 1) + 104_729 * (k + 1) + 31 * j) for j in range(n))


HEADER = ["Welcome to our site", "All the news you need", "Updated several times a day"]
FOOTER = ["Imprint and contact of ours", "All rights are reserved here", "Back to the top now"]


@pytest.mark.parametrize("n", [2, 3])
def test_headers_and_footers_of_several_lines(spark, n):
    rows = ["\n".join([*HEADER[:n], *(words(i, k) for k in range(3)), *FOOTER[-n:]]) for i in range(20)]
    rows += ["\n".join(words(900, k) for k in range(4))] * 20
    near = [words(950, k) for k in range(12)]  # near copies, one line of each is changed
    rows += ["\n".join([*near[: i % 12], words(960 + i, 0), *near[i % 12 + 1 :]]) for i in range(24)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    for i in range(20):
        assert found[i].text == "\n".join(words(i, k) for k in range(3))
    assert all(found[20 + i].n_dropped == 0 for i in range(44))


def test_copies_do_not_hide_boilerplate(spark):
    licence = "Licensed to you under these terms"
    rows = ["\n".join([words(i, 0), licence, words(i, 1), words(i, 2)]) for i in range(40)]
    copy = [words(900, k) for k in range(4)]
    rows += ["\n".join([*copy[:2], licence, *copy[2:]])] * 60
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = line_dedup.drop_lines(df).collect()
    assert len(found) == 100 and all(r.n_dropped == 1 and licence not in r.text for r in found)


def test_several_templates_in_a_leaf(spark):
    one = lambda i, k: words(i, k, 1)
    shared = [
        lambda i: f"This article was written by {one(i, 10)}",
        lambda i: f"This article can displease {one(i, 11)} readers",
    ]
    rows = ["\n".join([words(i, 0), shared[i % 2](i), words(i, 1), words(i, 2)]) for i in range(40)]
    # Ordinary lines of the same leaf, more than of both templates together.
    plain = [f"This article {words(100 + i, 3, 4)}" for i in range(60)]
    rows += ["\n".join([words(100 + i, 0), plain[i], words(100 + i, 1)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    assert all(found[i].n_dropped == 1 and "article" not in found[i].text for i in range(40))
    assert all(found[40 + i].n_dropped == 0 for i in range(60))


def test_short_lines_and_lines_without_spaces(spark):
    han = lambda i, k: "".join(chr(0x4E00 + (7919 * (i + 1) + 104_729 * k + 613 * j) % 20_000) for j in range(12))
    thai, footer = "สงวนลิขสิทธิ์ทุกประการ", "版权所有第{}页不得转载本文"
    rows = ["\n".join([words(i, 0), "Read more", words(i, 1), "42", words(i, 2), "Log in"]) for i in range(20)]
    rows += ["\n".join([han(i, 0), han(i, 1) + "7", footer.format(i), han(i, 2), thai, han(i, 3)]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    for i in range(20):
        assert found[i].text == "\n".join([words(i, 0), words(i, 1), "42", words(i, 2)])
        assert found[20 + i].text == "\n".join([han(i, 0), han(i, 1) + "7", han(i, 2), han(i, 3)])


def test_odd_rows_lines(odd, no_docs):
    left = line_dedup.drop_lines(odd)
    assert left.columns[:-2] == odd.columns and left.columns[-2:] == ["_n_lines", "n_dropped"]
    texts = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in odd.collect())
    assert sorted((str(r.doc_id), str(r.text), r.n_chars) for r in left.collect()) == texts
    assert line_dedup.drop_lines(no_docs).count() == 0


def peak_mb(make, batch):
    """MB of Python and numpy that a task's function takes at most for a batch."""
    each = make()
    tracemalloc.start()
    try:
        for _ in each(batch):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_work_on_a_batch_takes_little_memory(monkeypatch, docs):
    """A stage's memory follows a slice of the batch, not the batch."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5_000)]
    texts = ["\n".join(" ".join(rng.choices(words, k=9)) for _ in range(60)) for _ in range(1_500)]
    assert sum(map(len, texts)) > 4_000_000
    seen = []
    for module in (line_dedup, suffix_dedup):
        monkeypatch.setattr(module, "arrow_map", lambda df, make, schema: seen.append(make))
    line_dedup._lines(docs, 2, True)
    suffix_dedup.suffixes(docs, 200, 32)
    n = np.arange(len(texts))
    lines, suffixes = seen
    assert peak_mb(lines, pa.RecordBatch.from_pydict({"id": n, "h": n, "text": texts})) < 25
    suffix_dedup._tables()
    raws = pa.array([t.encode() for t in texts])
    assert peak_mb(suffixes, pa.RecordBatch.from_arrays([pa.array(n), raws], ["doc", "raw"])) < 50


def test_texts_come_in_short_batches(spark):
    def make():
        return lambda batch: [{"n": [batch.num_rows]}]

    was = spark.conf.get(BATCH_ROWS)
    rows = arrow_map(spark.range(0, 2 * TEXT_ROWS + 5, 1, 1), make, "n bigint")
    with pytest.raises(KeyError), text_batches(spark):
        assert [r.n for r in rows.collect()] == [TEXT_ROWS, TEXT_ROWS, 5]
        raise KeyError
    assert spark.conf.get(BATCH_ROWS) == was


def test_stages_ask_for_short_batches(spark, monkeypatch):
    given = []
    docs = spark.range(1)
    monkeypatch.setattr(line_dedup, "_without", lambda docs, ws: docs)
    monkeypatch.setattr(minhash, "_one_of_each", lambda docs, ws, k, percent: docs)
    monkeypatch.setattr(Workspace, "keep", lambda ws, df, name: given.append(spark.conf.get(BATCH_ROWS)))
    line_dedup.drop_lines(docs)
    minhash.one_of_each(docs)
    assert given == [str(TEXT_ROWS)] * 2


def test_a_group_compared_in_one_task_takes_little_memory(monkeypatch):
    made = []
    monkeypatch.setattr(suffix_dedup, "grouped_map", lambda rows, keys, order, each, *_: made.append(each))
    suffix_dedup._compared(None, 200)
    k, rng = suffix_dedup.GROUP, random.Random(3)
    t = pa.table({
        "fp": np.zeros(k, np.int64), "single": np.ones(k, bool), "doc": np.arange(k), "first": np.zeros(k, np.int64),
        "far": np.full(k, 168), "size": np.full(k, 169), "raw": pa.array([rng.randbytes(368) for _ in range(k)]),
    })
    suffix_dedup._tables()
    assert peak_mb(lambda: lambda t: made[0](t, np.ones(k, np.int64)), t) < 100
