import random
from itertools import combinations

import numpy as np
import pytest

from kgflow import session
from kgflow.llm import leakage, overlap
from kgflow.llm.winnow import hashed_units, unit_characters, unit_ids, winnow


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        if not out:
            break
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [f"new{rng.random()}"], [out[i], f"add{rng.random()}"]])
    return out


def test_distance_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(0, 90))]
        b = edited(rng, a, rng.randrange(0, 12)) if a and rng.random() < 0.7 else [rng.choice("abcdef") for _ in range(rng.randrange(0, 90))]
        true, most = plain_distance(a, b), rng.randrange(0, 20)
        assert overlap.distance(a, b, most) == (true if true <= most else most + 1)


def test_chains_are_longest_and_their_extension_is_an_alignment():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.choice([2, 3])
        seeds = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(rng.randrange(0, 9))})
        got = overlap.chain(seeds, k)
        fits = lambda c: all(a[0] + k <= b[0] and a[1] + k <= b[1] for a, b in zip(c, c[1:]))  # noqa: B023, E731
        longest = max((len(c) for n in range(len(seeds) + 1) for c in combinations(seeds, n) if fits(c)), default=0)
        assert fits(got) and len(got) == longest and set(got) <= set(seeds)
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(10, 60))]
        b = edited(rng, a, rng.randrange(0, 6))
        same = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k] and rng.random() < 0.7]
        true, (d, n) = plain_distance(a, b), overlap.extended(a, b, same, k, 99)
        assert true <= d <= len(a) + len(b) and n == len(overlap.chain(same, k)) and (d == true or same)
        assert overlap.extended(a, b, same, k, d)[0] == d and (not d or overlap.extended(a, b, same, k, d - 1)[0] == d)


def test_shared_spans_share_a_fingerprint():
    rng, seen = random.Random(2), {}
    for _ in range(200):
        k, w = rng.choice([(3, 3), (6, 3), (5, 4)])
        span = [f"s{rng.randrange(40)}" for _ in range(k + w - 1)]
        texts = [[f"x{rng.random()}" for _ in range(rng.randrange(12))] + span + [f"y{rng.random()}" for _ in range(rng.randrange(12))] for _ in range(2)]
        coded = [unit_ids(t, seen) for t in texts]
        owner, _, h = winnow(np.concatenate(coded), np.array([len(c) for c in coded]), k, w)
        assert set(h[owner == 0]) & set(h[owner == 1])
    assert [len(x) for x in winnow(np.zeros(2, np.uint64), np.array([1, 1]), 3, 3)] == [0, 0, 0]


def chunk_pairs(spark, rows):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "id long, text string, split_name string, source string, w string, cls int")
    links, members = overlap.split_overlaps(df)
    report = overlap.coverage_report(df, links, members).collect()
    return {(r.id_a, r.id_b) for r in overlap.found_pairs(links, members).collect()}, report


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)] + [f"name{i}" for i in range(4000)]
    texts = []
    for i in range(150):
        base = [rng.choice(vocabulary[:60] if rng.random() < 0.6 else vocabulary) for _ in range(rng.randrange(8, 90))]
        texts += [base, edited(rng, base, rng.randrange(0, 1 + len(base) // 10))]
    rows = [(i, " ".join(t).upper() + ("!" if i % 2 else ""), ("train", "test", "validation")[rng.randrange(3)], f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(9000, None, "train", "s"), (9001, "", "test", "s"), (9002, "...", "test", "s"), (9003, rows[0][1], "train", None), (9004, rows[0][1].lower(), "test", None), (9004, rows[0][1].lower(), "test", None), (9005, rows[0][1], None, "s")]
    got, report = chunk_pairs(spark, rows)
    split = [(r[0], (r[1] or "").lower().replace("!", "").replace(".", "").split(), r[2]) for r in rows if r[2]]
    want = {
        (min(a, b), max(a, b)) for a, x, s in split if s == "train" for b, y, t in split
        if t != "train" and x and y and abs(len(x) - len(y)) * 5 <= max(len(x), len(y)) and 5 * overlap.distance(x, y, 99) <= max(len(x), len(y))
    }
    assert len(want) > 40
    assert want == got
    assert sum(r.records for r in report) == len(rows) and all(0 <= r.coverage <= 1 for r in report)


def test_hot_copies_and_near_copies_are_all_found(spark):
    text = " ".join(f"common{i}" for i in range(60))
    near = text.replace("common30", "other")
    rows = [(i, text if i % 2 else near, "train" if i < 120 else "test", "s") for i in range(150)]
    got, _ = chunk_pairs(spark, rows)
    assert len(got) == 120 * 30
    assert chunk_pairs(spark, [])[0] == set()


def test_near_copies_that_differ_from_one_another_though_all_fingerprints_are_hot(spark):
    base = [f"common{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"u{i}"] + base[31:]), "train" if i < 60 else "test", "s") for i in range(80)]
    assert len(chunk_pairs(spark, rows)[0]) == 60 * 20


@pytest.fixture(scope="module")
def leak_case():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(900)}"
    items = [(i, [word() for _ in range(rng.randrange(24, 70))]) for i in range(12)]
    docs, want = [], set()
    for n in range(60):
        lead, tail = [word() for _ in range(rng.randrange(0, 200))], [word() for _ in range(rng.randrange(0, 90))]
        i, t = items[n % 12]
        if n % 3 == 0:
            half = (len(t) + 1) // 2 + rng.randrange(0, 5)
            at = rng.randrange(0, len(t) - half + 1)
            part, ok = edited(rng, t[at : at + half], max(0, half // 9 - 1)), True
        elif n % 3 == 1:
            part, ok = t[: len(t) // 3], False
        else:
            part, ok = edited(rng, t, len(t) // 10), True
        docs.append((n, ". ".join([" ".join(lead), " ".join(part).title(), " ".join(tail)])))
        if ok:
            want.add((n, i))
    return items, docs, want


def test_leaks_of_halves_and_edited_items(spark, leak_case):
    items, docs, want = leak_case
    i = spark.createDataFrame([(a, " ".join(t), "q") for a, t in items] + [(90, None, "q"), (91, "", "q"), (92, "?!", "q")], "item_id long, text string, suite string")
    d = spark.createDataFrame([(*x, 1) for x in docs] + [(900, None, 1), (901, "", 1), (docs[0][0], docs[0][1], 1)], "doc_id long, text string, item_id int")
    rows = leakage.leaks(d, i).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert want - got == set()
    assert len(got - want) == 0 and all(0.5 <= r.held <= 1 for r in rows)
    assert sum(r.doc_id == docs[0][0] for r in rows) == 2


def test_leaks_in_letters_short_items_and_empty_tables(spark):
    zh = "当链路拥塞时路由器会在八十三毫秒内检查所有的数据包并且丢弃迟到的应答报文"
    i = spark.createDataFrame([(1, zh), (2, "only four words here")], "item_id long, text string")
    d = spark.createDataFrame([(1, "前言。" + zh[:24] + "，结束"), (2, "无关的文字，没有任何关系"), (3, "say: ONLY four, maybe"), (4, zh[:9])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == {(1, 1), (3, 2)}
    assert leakage.leaks(d.limit(0), i).collect() == [] and leakage.leaks(d, i.limit(0)).collect() == []


def test_fingerprints_joined_by_shuffle_give_the_same(spark, leak_case, monkeypatch):
    items, docs, want = leak_case
    monkeypatch.setattr(leakage, "BROADCAST_PRINTS", 5)
    monkeypatch.setattr(leakage, "MOST_BITS", 16)
    i = spark.createDataFrame([(a, " ".join(t)) for a, t in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), i).collect()} == want


def test_hashed_units_are_the_words_and_letters():
    texts = ["Hello, WORLD hello 12ab", "", "日本語 a_b é", "...", "world \U0001d7d8x"]
    used = unit_characters()
    units, sizes = hashed_units(texts, False, used)
    assert sizes.tolist() == [4, 0, 4, 0, 2] and units[1] == units[8] and units[0] == units[2] and len(set(units.tolist())) == 8
    assert hashed_units(texts, True, used)[1].tolist() == [19, 0, 6, 0, 7]
    assert hashed_units([], False, used)[1].tolist() == [] and hashed_units(["-"], True, used)[1].tolist() == [0]


def test_very_long_texts(spark):
    rng = random.Random(11)
    long = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    near = edited(rng, long, 900)
    got, _ = chunk_pairs(spark, [(1, " ".join(long), "train", "s"), (2, " ".join(near), "test", "s"), (3, " ".join(near[:9000]), "test", "s")])
    assert got == {(1, 2)}
    item = [f"q{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(long + item[:30] + long)), (2, " ".join(long + item[:15] + long))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()} == {(1, 7)}


def test_many_records_share_a_passage_but_are_no_overlap(spark):
    rng = random.Random(12)
    notice = [f"notice{i}" for i in range(25)]
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(40)] + notice + [f"b{rng.randrange(10**6)}" for _ in range(20)]), "train" if i % 4 else "test", "s") for i in range(600)]
    assert chunk_pairs(spark, rows)[0] == set()


def near_by_hand(rows):
    split = [(i, t.split(), s) for i, t, s, _ in rows]
    return {
        (min(a, b), max(a, b)) for a, x, s in split if s == "train" for b, y, t in split
        if t != "train" and 5 * overlap.distance(x, y, max(len(x), len(y)) // 5) <= max(len(x), len(y)) // 5 * 5
    }


def test_variants_of_one_text_with_hot_passages_are_all_found(spark):
    rng = random.Random(21)
    base = [f"common{i}" for i in range(60)]
    variant = lambda share: [f"new{rng.random()}".replace(".", "") if i in at else w for at in [set(rng.sample(range(60), int(60 * share)))] for i, w in enumerate(base)]
    rows = [(0, " ".join(base), "test", "s")] + [(i, " ".join(variant(rng.choice([0.1, 0.15, 0.2]))), "train", "s") for i in range(1, 51)]
    rows += [(100 + i, " ".join(variant(0.05)), "validation", "s") for i in range(30)]
    want = near_by_hand(rows)
    assert {(0, i) for i in range(1, 51)} <= want and len(want) > 200
    assert chunk_pairs(spark, rows)[0] == want


def test_groups_of_a_hot_gram_are_spread_without_loss(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 7)
    test_variants_of_one_text_with_hot_passages_are_all_found(spark)


def test_short_and_evenly_edited_pairs_are_all_found(spark):
    rng = random.Random(22)
    rows = []
    for n in [*range(1, 31), 37, 45, 60, 64, 65, 79, 80, 130, 200]:
        base = [f"n{n}w{i}" for i in range(n)]
        d = n // 5
        replaced = [f"r{rng.randrange(10**9)}" if i % 5 == 2 and i // 5 < d else w for i, w in enumerate(base)]
        fewer = [w for i, w in enumerate(base) if not (i % 5 == 4 and i // 5 < d)]
        more = [x for i, w in enumerate(base) for x in ([w, f"a{rng.randrange(10**9)}"] if i % 4 == 1 and i // 4 < n // 4 else [w])]
        at = set(rng.sample(range(n), d))
        anywhere = [f"q{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(base)]
        for t in (base, replaced, fewer, more, anywhere):
            rows += [(2 * len(rows), " ".join(t), "train", "s"), (2 * len(rows) + 1, " ".join(t), "test", "s")]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    want = near_by_hand(rows)
    assert len(want) > 300
    assert chunk_pairs(spark, rows)[0] == want


@pytest.mark.parametrize("k", [2, 3])
def test_chosen_grams_share_no_word_and_cost_least(k):
    rng = np.random.default_rng(1)
    sizes = rng.integers(4 if k == 2 else 12, 12 if k == 2 else 17, 60)
    cost = rng.integers(1, 50, (60, overlap.BLOCK)).astype(np.float32)
    row, place = overlap.choose(cost, sizes, k)
    for r, n in enumerate(sizes):
        got = sorted(place[row == r])
        assert len(got) == n // 4 + 1 and got[-1] + k <= n and all(b - a >= k for a, b in zip(got, got[1:]))
        every = [c for c in combinations(range(n - k + 1), n // 4 + 1) if all(b - a >= k for a, b in zip(c, c[1:]))]
        assert cost[r, got].sum() == min(cost[r, list(c)].sum() for c in every)


def allowed(item, part):
    """Whether `part` is a passage of half the item with an eighth edited, by plain dynamic programming over all stretches of the item."""
    n = len(item)
    for a in range(n):
        prev = list(range(len(part) + 1))
        for x, u in enumerate(item[a:], 1):
            cur = [x]
            for j, v in enumerate(part, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (u != v)))
            prev = cur
            if 2 * x >= n and 8 * prev[-1] <= max(x, len(part)):
                return True
    return False


@pytest.mark.parametrize("prints", [1_000_000, 0], ids=["broadcast", "joined"])
@pytest.mark.parametrize("letters", [False, True])
def test_halves_of_items_of_any_length_are_found_however_edited(spark, letters, prints, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_PRINTS", prints)
    rng = random.Random(31)
    join = (lambda x: "".join(x)) if letters else " ".join
    unit = (lambda i: chr(0x4E00 + i)) if letters else (lambda i: f"w{i}")
    items, docs, want = [], [], set()
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 11, 14, 16, 17, 18, 19, 20, 24, 27, 30, 32, 40, 48, 56, 64, 96, 97, 120]:
        item = [unit(len(items) * 150 + i) for i in range(n)]
        items.append((n, join(item)))
        for kind in ("even", "added", "random", "too many"):
            half = (n + 1) // 2
            start = rng.randrange(0, n - half + 1)
            part = item[start : start + half]
            d = half // 7 if kind == "added" else half // 8 + (kind == "too many") * (2 + half // 4)
            at = [round((j + 1) * (half + 1) / (d + 1)) - 1 for j in range(d)] if kind != "random" else rng.sample(range(half), d)
            if kind == "added":
                part = [x for i, u in enumerate(part) for x in ([unit(15_000 + i), u] if i in at else [u])]
            else:
                part = [unit(16_000 + i) if i in at else u for i, u in enumerate(part)]
            lead = [unit(18_000 + rng.randrange(900)) for _ in range(30)]
            docs.append((len(docs), join(lead + part + lead[::-1])))
            if allowed(item, part):
                want.add((docs[-1][0], n))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 70 and want <= {(r.doc_id, r.item_id) for r in got}
    assert len(got) == len(want)


def test_a_shape_is_sure():
    for n in (*range(1, 130), 300):
        for letters in (False, True):
            k, window, need = leakage.shape(n, letters)
            for x, added, e in leakage.cases(n):
                runs = -(-(x - e + added) // (e + 1))
                assert runs >= k + window - 1 and need >= 1


def test_train_is_counted_whole(spark):
    """Every gram of every record counts, also past any sample's bound."""
    n = 60_000
    df = spark.range(n).selectExpr("concat_ws(' ', 'x', 'y', 'z', 'u', 'v', 'w', 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'n') AS w")
    counts = overlap.gram_counts(df)
    assert counts.sum() == n * 14 and counts.max() == n


def test_joining_in_parts_gives_the_same_links_and_leaves_no_files(spark, monkeypatch, tmp_path):
    import glob

    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(90)}" for _ in range(rng.randrange(4, 60))]
        rows += [(2 * i, " ".join(w), "train", "s"), (2 * i + 1, " ".join(x if rng.random() > 0.15 else "new" for x in w), "test", "s")]
    df = spark.createDataFrame(rows, "id long, text string, split_name string, source string")
    want = {(a, b, overlap.distance(x.split(), y.split(), max(len(x.split()), len(y.split())) // 5)) for a, x, p, _ in rows for b, y, q, _ in rows if p == "train" != q}
    texts = {i: t.split() for i, t, _, _ in rows}
    want = {(a, b) for a, b, d in want if d <= max(len(texts[a]), len(texts[b])) // 5}
    for at_once in (overlap.AT_ONCE, 1):
        monkeypatch.setattr(overlap, "AT_ONCE", at_once)
        before = set(glob.glob(f"{session.shared_dir(spark).removeprefix('file:')}/*"))
        got = overlap.split_overlaps(df)
        assert {(r.id_a, r.id_b) for r in overlap.found_pairs(*got).collect()} == {(min(p), max(p)) for p in want}
        left = set(glob.glob(f"{session.shared_dir(spark).removeprefix('file:')}/*")) - before
        assert len(left) == 2  # links and members
