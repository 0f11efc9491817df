"""Operators on pairs and sets of records: overlap, splits, look-alikes, formatting duplicates, leaks."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import confusables, eval_leaks, formatting_duplicates, split_components, split_overlap
from tests.conftest import rows


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)]


def test_suffix_order_and_matches_against_brute_force():
    r = random.Random(3)
    vocab = words(r, 12)
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 25))) for _ in range(60)] + ["x"] * 1
    index = split_overlap.Index.build(texts)
    train = [" ".join(r.choice(vocab) for _ in range(14)) for _ in range(10)] + texts[:3]
    h, sizes = split_overlap._words(train)
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(train)), sizes)
    end, size, lo, hi = index.matches(h, begin[at], sizes[at])
    flat = [w for t in train for w in t.split()]
    for e, n, a, b in zip(end, size, lo, hi):
        run = " ".join(flat[e - n + 1 : e + 1])
        held = sorted(k for k, t in enumerate(texts) for i in range(len(t.split())) if t.split()[i : i + n] == run.split())
        assert sorted(index.text_of[a:b].tolist()) == held


def overlap_fixture(spark):
    r = random.Random(5)
    base = [" ".join(words(r, r.randint(6, 30))) for _ in range(60)]
    typo = [t[:10] + "x" + t[11:] for t in base[:10]]
    swapped = [" ".join(w[:3] + [w[4], w[3]] + w[5:]) for w in (t.split() for t in base[10:20])]
    evaluation = base[20:25] + typo + swapped + [" ".join(words(r, 12)) for _ in range(20)] + ["one", "", None, base[20]]
    train = base + ["one", "", None, base[0]]
    ev = spark.createDataFrame([("test", k, "s", t, "clash") for k, t in enumerate(evaluation)], "split_name string, eval_id bigint, source string, text string, digest string")
    return spark.createDataFrame([(t, 1.0) for t in train], "text string, similarity double"), ev, train, evaluation


def test_overlaps_equal_brute_force(spark):
    tr, ev, train, evaluation = overlap_fixture(spark)
    best = lambda q: max(SequenceMatcher(None, q, t, autojunk=False).ratio() for t in train if t)
    want = {k for k, q in enumerate(evaluation) if q and best(q) >= 0.9}
    got = {r[0]: r[1] for r in split_overlap.overlaps(tr, ev).select("eval_id", "similarity").collect()}
    assert set(got) == want
    assert all(abs(got[k] - best(evaluation[k])) < 1e-9 for k in got)


def test_overlap_of_a_hot_family_and_long_texts(spark):
    frame = "dear customer your account {} is blocked please confirm the code now and call the number below"
    train = spark.createDataFrame([(frame.format(f"n{k}"),) for k in range(80)] + [(" ".join(f"w{k}" for k in range(20_000)),)], "text string")
    ev = [("test", k, "s", frame.format(f"m{k}")) for k in range(80)] + [("test", 99, "s", " ".join(f"w{k}" for k in range(20_000)))]
    got = split_overlap.overlaps(train, spark.createDataFrame(ev, "split_name string, eval_id bigint, source string, text string"))
    assert {r["eval_id"] for r in got.collect()} == {*range(80), 99}


def test_index_files_are_written_by_the_tasks_and_read_whole(spark, monkeypatch):
    r = random.Random(17)
    texts = [" ".join(words(r, r.randint(1, 30))) for _ in range(200)]
    monkeypatch.setattr(split_overlap, "SHARD_WORDS", 1500)
    files = split_overlap.build_index(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(files) > 1
    held = []
    for f in files:
        index, docs, parts = split_overlap._load(f)
        again, same = split_overlap.Index.build(docs.texts), split_overlap.Texts(docs.texts)
        for a, b, names in ((index, again, ("vocab", "keys", "before", "text_of")), (docs, same, ("bags", "bigrams", "grams"))):
            assert all(np.array_equal(getattr(a, n), getattr(b, n)) and getattr(a, n).dtype == getattr(b, n).dtype for n in names)
        assert sorted(np.concatenate([g.order for g in parts]).tolist()) == list(range(len(docs.texts)))
        held += docs.texts
    assert sorted(held) == sorted(texts)


def test_overlap_of_empty_tables(spark):
    tr, ev, *_ = overlap_fixture(spark)
    assert split_overlap.overlaps(tr.limit(0), ev).count() == 0
    assert split_overlap.overlaps(tr, ev.limit(0)).count() == 0
    assert rows(split_overlap.report(tr.limit(0), ev)) == [("test", "s", ev.count(), 0, 0)]


def sources(spark, items):
    return spark.createDataFrame([(g, k, "author", "clash") for g, k in items], "group_id bigint, source_key string, link_kind string, vertex string")


def test_components_against_union_find(spark):
    r = random.Random(9)
    items = [(g, f"AU-{r.randint(0, 150):05d}") for g in range(200) for _ in range(r.randint(0, 2))]
    items += [(g, "hot key") for g in range(200, 260)] + [(g, r.choice(["unknown", "N/A", " - ", "", None])) for g in range(40)]
    items += [(5, "Hot_KEY"), (5, "Hot_KEY"), (None, "hot key")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for g, k in items:
        k = "".join(c for c in (k or "").lower() if c.isalnum())
        if g is not None and k not in ("", "unknown", "na"):
            parent[find(("k", k))] = find(g)
    sets = {}
    for x in list(parent):
        if not isinstance(x, tuple):
            sets.setdefault(find(x), []).append(x)
    want = sorted((min(s), g) for s in sets.values() for g in s if g != min(s))
    assert rows(split_components.tied(sources(spark, items))) == want
    assert rows(split_components.tied(sources(spark, []))) == []


def test_splits_keep_components_and_shares(spark):
    items = [(g, f"K{g // 3}") for g in range(900)]
    msgs = spark.range(6000).select((F.col("id") % 1000).alias("group_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    p = split_components.splits(msgs.unionByName(msgs.where("group_id = 7").limit(3)), sources(spark, items)).toPandas()
    assert len(p) == 1000 and (p.groupby("component_id").part.nunique() == 1).all()
    share = p.groupby("part").n_rows.sum() / p.n_rows.sum()
    assert abs(share["train"] - 0.64) < 0.03 and abs(share["test"] - 0.2) < 0.03
    assert split_components.splits(msgs.limit(0), sources(spark, [])).count() == 0


def test_splits_have_like_label_shares_and_all_languages(spark):
    hot = [(k, 5000, 1, ("text", "text_de")[k % 2]) for k in range(500)]
    rest = [(1000 + k, k // 3, int(k % 9 == 0), ("text", " TEXT_FR", "text_de")[k % 3]) for k in range(4500)]
    rare = [(9000 + k, 6000 + k, 0, "text_hi") for k in range(3)] + [(9100, 7000, None, None), (9101, None, 1, "text")]
    msgs = spark.createDataFrame([(*x, "clash") for x in hot + rest + rare], "row_index bigint, group_id bigint, label int, language_column string, part string")
    p = split_components.splits(msgs, sources(spark, []))
    j = msgs.drop("part").join(p, "group_id").toPandas()
    share = j.groupby("part").label.mean()
    assert share.max() - share.min() < 0.02
    assert abs((j.part == "train").mean() - 0.64) < 0.03
    assert (j.assign(lang=j.language_column.str.strip().str.lower()).groupby("lang").part.nunique() == 3).all()


def test_look_alikes(spark):
    t = ["Café  now", "Café  now", "Саfé  now", "CAFÉ  NOW", "Cafe  now", "Ｃａｆé  now", None, None, "", "​", "Café  now", "Café now"]
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(t)], "row_index bigint, raw_text string, look string")
    same = {0, 1, 2, 5, 10}
    want = sorted([(a, b) for a in same for b in same if a < b and t[a] != t[b]] + [(8, 9)])
    assert rows(confusables.look_alikes(df)) == want
    assert rows(confusables.look_alikes(df.limit(0))) == []
    assert rows(confusables.classes(df)) == sorted([(0, min(b for b in same if t[b] == t[a]), a) for a in same] + [(8, 8, 8), (8, 9, 9)])
    assert confusables.skeleton("𝐭𝐞 ﬁ Μοѕсоw") == "te fi Moscow" and len(confusables.skeleton("é" * 100_000)) == 200_000


def test_formatting_duplicates(spark):
    m = "Subject: Big Sale | Sender: a@b.c | List: x | Body: Buy, now! €5"
    t = [
        ("mail_archive", 1, m), ("mail_archive", 1, "body: buy now €5\nLIST: X\n\nsender: A@B.C;subject: big  sale"), ("mail_archive", 0, m), ("tube", 1, m),
        ("tube", None, "GROSSE Straße — (wow)"), ("tube", None, "große  STRASSE wow!"), ("tube", 1, "one two"), ("tube", 1, "two one"), ("tube", 1, None), ("tube", 1, None), ("tube", 1, "!!"), ("tube", 1, ""), (None, 1, "a b"), (None, 1, "A-b"), (None, 1, "A, b"),
        ("tube", 1, "x " * 50_000), ("tube", 1, "X  " * 50_000),
    ]
    df = spark.createDataFrame([(k, d, x, y, "clash", "clash") for k, (d, y, x) in enumerate(t)], "record_id bigint, dataset string, raw_text string, label int, root string, tree string")
    assert rows(formatting_duplicates.copies(df)) == [(0, 1), (4, 5), (10, 11), (12, 14), (15, 16)]
    assert sum(r["n_copies"] for r in formatting_duplicates.collapsed(df).collect()) == len(t) - 2
    assert rows(formatting_duplicates.copies(df.limit(0))) == []


def test_myers_against_dynamic_programming():
    r = random.Random(1)
    for _ in range(200):
        p, t = "".join(r.choice("abc") for _ in range(r.randint(1, 9))), "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            old, row = row, [i] + [0] * len(t)
            for j, x in enumerate(t, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != x))
        assert eval_leaks.myers(p, t, 99) == min(row)


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    items = [(k, "d", " ".join(words(r, r.choice([10, 16, 40, 47])))) for k in range(30)] + [(90, "d", None)]
    docs = []
    for k in range(80):
        w = words(r, 20)
        item = items[r.randrange(30)][2].split()
        n = r.choice([0, 8, 15, 16, 17, 30])
        s = r.randint(0, max(0, len(item) - n))
        part = [x.upper() + "," if r.random() < 0.3 else x for x in item[s : s + n]]
        docs.append((k, " ".join(w[:9]) + "\n> " + "  ".join(part) + "<br>" + " ".join(w[9:]), "clash"))
    docs += [(200, None, ""), (201, "", ""), (202, "word " * 50_000, "")]
    want = set()
    for d, t, _ in docs:
        dw = " " + " ".join(eval_leaks.words_of(t or "")) + " "
        for i, _, x in items:
            iw = eval_leaks.words_of(x or "")
            if any(" " + " ".join(iw[k : k + 16]) + " " in dw for k in range(len(iw) - 15)):
                want.add((d, i))
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string, run_words string"), spark.createDataFrame(items, "item_id bigint, dataset string, text string")
    assert set(rows(eval_leaks.leaks(dd, ii))) == want and want
    assert rows(eval_leaks.leaks(dd.limit(0), ii)) == [] and rows(eval_leaks.leaks(dd, ii.limit(0))) == []


def test_near_leak_within_the_budget(spark):
    item = " ".join(f"word{k}" for k in range(24))
    docs = spark.createDataFrame([(1, item.replace("word9", "wordX")), (2, " ".join(f"other{k}" for k in range(24)))], "doc_id bigint, text string")
    got = rows(eval_leaks.passages(docs, spark.createDataFrame([(7, "d", item)], "item_id bigint, dataset string, text string")))
    assert got == [(1, 7, 14, 1)]


def test_overlap_without_a_rare_common_run(spark):
    r = random.Random(7)
    vocab = [w for w in words(r, 200) if len(w) > 4][:30]
    line = lambda: [r.choice(vocab) for _ in range(12)]
    train = [" ".join(line()) for _ in range(400)] + ["telephones"]
    noisy = [" ".join(w[:2] + w[2] + w[2:] if k % 2 else w for k, w in enumerate(t.split())) for t in train[:40]]
    evaluation = noisy + [" ".join(line()) for _ in range(400)] + ["telephone", "telegraph"]
    best = lambda q: max(SequenceMatcher(None, q, t, autojunk=False).ratio() for t in train)
    want = {k: best(q) for k, q in enumerate(evaluation) if k < 40 or k >= 440 or best(q) >= 0.9}
    want = {k: x for k, x in want.items() if x >= 0.9}
    ev = spark.createDataFrame([("test", k, "s", t) for k, t in enumerate(evaluation)], "split_name string, eval_id bigint, source string, text string")
    got = {r[0]: r[1] for r in split_overlap.overlaps(spark.createDataFrame([(t,) for t in train], "text string"), ev).select("eval_id", "similarity").collect()}
    assert len(want) >= 40 and 440 in want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_near_leak_at_every_offset_and_edit(spark):
    item = [f"w{k:02d}x{'abcdefgh'[k % 8]}" for k in range(40)]
    docs = []
    for begin in range(25):
        for k in range(16):
            w = item[begin : begin + 16]
            docs += [(len(docs), " ".join([*w[:k], w[k][:2] + "Q" + w[k][3:], *w[k + 1 :]])), (len(docs) + 1, " ".join(w[: k + 1]) + " ".join(["", *w[k + 1 :]])[k % 2 :])]
    dd = spark.createDataFrame([(k, f"before it {t} after it") for k, t in docs], "doc_id bigint, text string")
    ii = spark.createDataFrame([(7, "d", " ".join(item)), (8, "d", "nothing of it " * 10)], "item_id bigint, dataset string, text string")
    got = rows(eval_leaks.passages(dd, ii))
    assert {r[0] for r in got} == {k for k, _ in docs} and all(r[1] == 7 and r[3] <= 1 for r in got)
    exact = sum(r[2] >= 16 for r in got)
    assert rows(eval_leaks.leaked_items(dd, ii)) == [(7, exact, len(docs) - exact, 16, "d")] and 0 < exact < len(docs)


def test_blocks_of_long_texts_are_those_of_the_sequence_matcher():
    r = random.Random(11)
    for _ in range(200):
        a = [r.choice("ab c") for _ in range(r.randint(0, 60))]
        b = [r.choice("abcd") if r.random() < 0.2 else c for c in a if r.random() < 0.9]
        want = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert split_overlap._matched("".join(a), "".join(b)) == want


def test_subsequences_of_many_pairs_equal_those_of_one():
    r = random.Random(12)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.choice([1, 5, 63, 64, 65, 128, 200, 3500])))
    a, b = (split_overlap.Texts([text() for _ in range(40)]) for _ in "ab")
    t, d = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    some = np.array(r.sample(range(1600), 200))
    assert split_overlap._subsequences(a, b, t[some], d[some]).tolist() == [split_overlap._common(b.texts[y], a.texts[x]) for x, y in zip(t[some], d[some])]


def test_near_copies_with_a_changed_letter_in_every_third_word(spark):
    r = random.Random(13)
    train = [" ".join(words(r, 18)) for _ in range(80)] + ["aaa " * 6000 + "b", " ".join(words(r, 12_000))]
    changed = lambda t: " ".join("q" + w[1:] if k % 3 == 0 else w for k, w in enumerate(t.split()))
    evaluation = [changed(t) for t in train[:50]] + ["aaa " * 6000 + "c", train[-1][:-1] + "?", " ".join(words(r, 12_000))]
    ev = spark.createDataFrame([("test", k, "s", t) for k, t in enumerate(evaluation)], "split_name string, eval_id bigint, source string, text string")
    got = split_overlap.overlaps(spark.createDataFrame([(t,) for t in train], "text string"), ev)
    assert {r["eval_id"] for r in got.collect()} == {*range(52)}


def test_second_filter_keeps_near_texts_and_drops_those_in_another_order(monkeypatch):
    monkeypatch.setattr(split_overlap, "_GROUP", 20)
    r = random.Random(23)
    train = [" ".join(words(r, r.randint(1, 40))) for _ in range(60)] + ["д" + " ".join(words(r, 9)) for _ in range(20)]

    def changed(t, ways):
        out = list(t)
        for _ in range(max(1, len(t) // 11)):
            k, way = r.randrange(len(out)), r.choice(ways)
            out[k : k + (way != "insert")] = [] if way == "delete" else [r.choice("abcxyz")]
        return "".join(out) or "a"

    evaluation = [changed(t, ways) for t in train for ways in (["insert"], ["delete"], ["swap"], ["insert", "delete", "swap"])]
    a, b = split_overlap.Texts(train), split_overlap.Texts(evaluation)
    parts = split_overlap.groups(b)
    assert len(parts) > 10 and any(g.axes.shape[1] for g in parts)
    t, d = (np.concatenate(x) for x in zip(*split_overlap._alike(a, b, parts)))
    ok = split_overlap._by_halves(a, b, t, d)
    held = set(zip(t[ok].tolist(), d[ok].tolist()))
    near = {(x, y) for x, p in enumerate(train) for y, q in enumerate(evaluation) if SequenceMatcher(None, q, p, autojunk=False).ratio() >= 0.9}
    assert len(near) > 150 and near <= held
    # The same letters, the halves exchanged.
    turned = split_overlap.Texts([p[len(p) // 2 :] + p[: len(p) // 2] for p in train[:60] if len(p) > 80])
    same = split_overlap.Texts([p for p in train[:60] if len(p) > 80])
    every = np.arange(len(same.texts))
    assert len(every) > 20 and split_overlap._by_halves(same, same, every, every).all() and split_overlap._by_halves(same, turned, every, every).mean() < 0.1


def test_several_texts_share_a_number_of_the_letter_filter():
    r = np.random.default_rng(31)
    for n, k in ((1, 63), (13, 127), (50, 700)):
        a, b = r.random((20, k)) < 0.5, r.random((k, n)) < 0.5
        mine, theirs = r.integers(-40, 90, 20), r.integers(-60, 60, (2, n))
        size = np.full(n, 150)
        bits = split_overlap._bits(k, (np.stack([mine] * 2), theirs), (np.array([100, 1000]), size))
        packed = split_overlap._packed(b, theirs, bits)
        many = 50 // bits
        assert many > 2 and packed.shape[1] == -(-n // many)
        for side in (0, 1):
            here = np.concatenate([a, -mine[:, None], np.ones((20, 1)), np.full((20, 1), side - 1), np.full((20, 1), -side)], axis=1)
            sums = (here @ packed).view(np.int64)
            room = np.stack([(sums >> bits * f & (1 << bits) - 1) - (1 << bits - 1) for f in range(many)], axis=2).reshape(20, -1)[:, :n]
            assert (room == a.astype(int) @ b - mine[:, None] - theirs[side]).all()


def test_letter_filter_gives_every_pair_whose_letters_allow_the_similarity(monkeypatch):
    monkeypatch.setattr(split_overlap, "_GROUP", 50)
    r = random.Random(37)
    make = lambda: " ".join(words(r, r.choice([1, 3, 12, 13, 14, 40, 300])))
    train = [make() for _ in range(300)] + ["a" * 4000, "д" * 700]
    evaluation = [t[: r.randint(len(t) * 8 // 10, len(t))] + make()[: len(t) // 9] for t in train]
    a, b = split_overlap.Texts(train), split_overlap.Texts(evaluation)
    got = {(x, y) for t, d in split_overlap._alike(a, b, split_overlap.groups(b)) for x, y in zip(t.tolist(), d.tolist())}
    common = np.minimum(a.bags[:, None].astype(int), b.bags[None].astype(int)).sum(axis=2)
    want = 2 * common >= 0.9 * (a.size[:, None] + b.size) - 1e-6
    assert got == set(zip(*(x.tolist() for x in np.nonzero(want)))) and 50 < want.sum() < want.size / 2


def test_evaluation_records_are_read_once(spark):
    tr, ev, *_ = overlap_fixture(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert split_overlap.overlaps(tr, ev.mapInArrow(counted, ev.schema)).count()
    assert seen.value == ev.count()
