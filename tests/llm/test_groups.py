"""Problems 4 to 8 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components as C
from quillon.llm import leakage, packing, sample, spans, splits
from quillon.llm.text import words

PAIRS = "pair_no long, split string, sample_id string, caption_id string, class_label string, dataset string, loaded_at timestamp, id string, node string, key string"


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape, monkeypatch):
    monkeypatch.setattr(C, "LAST_LEVEL", 20)  # several levels even here
    rng = random.Random(2)
    edges = {
        "chain": [(f"n{i}", f"n{i + 1}") for i in range(300)],
        "star": [("hub", f"n{i}") for i in range(300)] + [("x", "y")],
        "random": [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(150)],
        "loops": [("a", "a"), ("b", "b"), ("a", "a"), (None, "c")],
    }[shape]
    rng.shuffle(edges)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a string, b string"), partitions=4).collect()}
    want = brute_components([e for e in edges if None not in e])
    assert set(got) == set(want)
    assert len(set(zip(got.values(), (want[k] for k in got)))) == len(set(want.values())) == len(set(got.values()))


def test_components_of_nothing(spark):
    assert C.components(spark.createDataFrame([], "a string, b string")).count() == 0


def make_pairs(n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.33 else f"S{rng.randrange(80)}"
        c = s if rng.random() < 0.9 else f"s{rng.randrange(80)}"
        style = rng.choice([str.lower, str.upper, lambda x: f"  {x} "])
        sid = None if rng.random() < 0.05 else style(f"d\\{s}" if rng.random() < 0.5 else f"d/{s}")
        cid = None if rng.random() < 0.05 else style(f"d/{c}") + f"#{i % 3}"
        split = None if rng.random() < 0.1 else ("train" if rng.random() < 0.9 else "test")
        rows.append((i, split, sid, cid, rng.choice(["a; b", " A;b", "c; d", None]), "d1", None, "x", "y", "z"))
    return rows


def names(row):
    tidy = lambda x: x.replace("\\", "/").lower().strip()
    out = []
    if row[2] is not None:
        out.append(tidy(row[2]))
    if row[3] is not None and "#" in row[3]:
        out.append(tidy(row[3].rpartition("#")[0]))
    return out


def brute_groups(rows):
    edges = [(("row", r[0]), ("name", n)) for r in rows for n in names(r)]
    comp = brute_components(edges)
    return {r[0]: comp.get(("row", r[0]), ("row", r[0])) for r in rows}


def test_conflicts_and_splits(spark):
    rows = make_pairs()
    df = spark.createDataFrame(rows, PAIRS).repartition(5)
    group = brute_groups(rows)
    seen = {}
    for r in rows:
        if r[1]:
            seen.setdefault(group[r[0]], set()).add(r[1])
    expected = {r[0] for r in rows if len(seen.get(group[r[0]], ())) > 1}
    got = [r.id for r in splits.split_conflicts(df).collect()]
    assert sorted(got) == sorted(expected) and expected
    out = splits.assign_splits(df).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    by = {}
    for r in out:
        by.setdefault(group[r.id], set()).add(r.new_split)
    assert all(len(s) == 1 for s in by.values())
    again = {r.id: r.new_split for r in splits.assign_splits(df.repartition(3)).collect()}
    assert again == {r.id: r.new_split for r in out}
    assert splits.assign_splits(df.limit(0)).count() == 0 and splits.split_conflicts(df.limit(0)).count() == 0


def test_splits_reach_their_shares(spark):
    rows = [(i, None, f"s{i // 2}", f"s{i // 2}#0", f"c{i % 4}", "d", None, "", "", "") for i in range(2000)]
    out = splits.assign_splits(spark.createDataFrame(rows, PAIRS)).groupBy("new_split").count().collect()
    share = {r.new_split: r["count"] / 2000 for r in out}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02


def test_sample_grows_and_keeps(spark):
    from datetime import datetime

    rows = [(i, None, f"S{i % 90}", f"s{i % 90}#{i % 3}", None, f"d{i % 90 % 2}", datetime(2030, 1 + i // 90 % 12, 1), "", "", "") for i in range(900)]
    rows += [(5000, None, None, None, None, None, None, "", "", ""), (5001, None, " s1 ", "S1#1 ", None, "d1", None, "", "", "")]
    df = spark.createDataFrame(rows, PAIRS)
    old = df.where(F.col("loaded_at") < "2030-05-01")
    cut = ["2030-03-01 00:00:00"]
    first = {r.key: r.step for r in sample.grow_sample(old, cut).collect()}
    more = {r.key: r.step for r in sample.grow_sample(df.repartition(9), [*cut, "2030-05-01 00:00:00"]).collect()}
    assert first and all(more[k] == s for k, s in first.items())
    again = {r.key: r.step for r in sample.grow_sample(df, [*cut, "2030-05-01 00:00:00"]).collect()}
    assert again == more
    n_keys = sample.sample_keys(df).count()
    assert n_keys / 10 <= len(more) <= n_keys / 10 + 2
    assert sample.grow_sample(df.limit(0), cut).count() == 0


def test_quota_below_ledger_drops_nothing(spark):
    keys = spark.createDataFrame([("a", f"k{i}", f"{i:04x}") for i in range(20)], "stratum string, key string, priority string")
    ledger = sample.extend_ledger(sample.empty_ledger(spark), keys, 500, 0)
    assert {r.key for r in ledger.collect()} == {f"k{i}" for i in range(10)}
    assert sample.extend_ledger(ledger, keys, 100, 1).count() == 10


def growing_pairs(spark, n=3000):
    from datetime import datetime, timedelta

    rng = random.Random(11)
    at = lambda: datetime(2031, 1, 1) + timedelta(minutes=rng.randrange(1_400_000))  # noqa: E731  to August 2033
    rows = [(i, None, f"S{i % 2500}", f"s{i % 2500}#1", None, rng.choice(["d1", "d2"]), at(), "", "", "") for i in range(n)]
    return spark.createDataFrame(rows, PAIRS)


BETWEEN = ["2031-12-20", "2032-07-01", "2033-01-15", "2033-06-01", "2034-01-01"]


def test_kept_ledger_drops_nothing_between_cutoffs(spark, tmp_path):
    from quillon.llm import queries as Q
    from quillon.session import remove_stages

    whole, held = growing_pairs(spark), {}
    for until in BETWEEN:
        whole.where(F.col("loaded_at") < until).write.mode("overwrite").parquet(f"{tmp_path}/pairs.parquet")
        now = {r.key: (r.stratum, r.step) for r in Q.p5_sample(spark, str(tmp_path)).collect()}
        assert held.items() <= now.items() and len(now) > len(held)
        remove_stages()  # as at the end of the process
        assert {r.key: (r.stratum, r.step) for r in Q.p5_sample(spark, str(tmp_path)).collect()} == now
        held = now


def test_kept_keys_survive_backdated_and_moved_rows(spark, tmp_path):
    from quillon.llm import queries as Q

    whole = growing_pairs(spark)
    folder = f"{tmp_path}/ledger"
    whole.where(F.col("loaded_at") < "2032-07-01").select(F.lit(1).alias("x")).limit(0).write.parquet(folder)
    first = {r.key: r.stratum for r in sample.grow_sample(whole.where(F.col("loaded_at") < "2032-07-01"), Q.CUTOFFS, folder=folder).collect()}
    late = whole.withColumn("pair_no", F.col("pair_no") + 10_000).withColumn("dataset", F.lit("d0"))
    early = late.withColumn("loaded_at", F.lit("2030-01-01").cast("timestamp")).withColumn("pair_no", F.col("pair_no") + 10_000)
    again = {r.key: r.stratum for r in sample.grow_sample(whole.unionByName(late).unionByName(early), Q.CUTOFFS, folder=folder).collect()}
    assert first and first.items() <= again.items()


def test_one_pass_equals_step_by_step(spark):
    rng = random.Random(4)
    keys = [(rng.choice("ab"), f"k{i}", f"{rng.randrange(40):04x}{i:08x}", rng.randrange(4)) for i in range(900)]
    got = {(r.key, r.step) for r in sample.new_entries(sample.empty_ledger(spark), spark.createDataFrame(keys, "stratum string, key string, priority string, arrival int"), 100, 4).collect()}
    want, chosen = set(), set()
    for step in range(4):
        for stratum in "ab":
            known = [k for k in keys if k[0] == stratum and k[3] <= step]
            room = -(-len(known) // 10) - sum(k[1] in chosen for k in known)
            new = sorted((k[2], k[1]) for k in known if k[1] not in chosen)[: max(0, room)]
            want |= {(k, step) for _, k in new}
            chosen |= {k for _, k in new}
    assert got == want


def test_closed_steps_are_rebuilt_alike(spark):
    from quillon.llm import queries as Q

    whole, held = growing_pairs(spark), set()
    for until in ["2031-05-01", *BETWEEN]:
        known = whole.where(F.col("loaded_at") < until)
        now = {(r.key, r.stratum, r.step) for r in sample.grow_sample(known, sample.closed_cutoffs(known, Q.CUTOFFS), open_step=False).collect()}
        assert held <= now
        held = now
    assert len({step for *_, step in held}) == 4
    assert sample.closed_cutoffs(whole.limit(0), Q.CUTOFFS) == []
    late = whole.withColumn("loaded_at", F.lit("2034-05-01 00:00:00").cast("timestamp"))
    assert sample.closed_cutoffs(late, Q.CUTOFFS)[3:] == ["2033-04-01 00:00:00", "2033-10-01 00:00:00", "2034-04-01 00:00:00"]


def test_packing_keeps_every_token(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices(["rise", "fall", "noise", "café"], k=rng.choice([1, 3, 10, 30, 200])))) for i in range(400)]
    texts += [(900, None), (901, ""), (902, "word " * 20_000), (903, "a" * 3000), (904, "x" + " " * 1_000_000 + "y")]
    df = spark.createDataFrame([(*t, "clash", 1) for t in texts], "doc_id long, text string, name string, part int")
    spec = spark.createDataFrame([(1, 32), (2, 256), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    out = packing.pack_texts(df, spec, slot_items=40).collect()
    enc = packing.encoder()
    count = {i: packing.count_tokens(enc, t) if t else 0 for i, t in texts}
    for s, capacity in ((1, 32), (2, 256)):
        rows = [r for r in out if r.spec_id == s]
        held, parts = {}, {}
        for r in rows:
            if r.container_id is None:
                assert count[r.doc_id] == 0
                continue
            held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append(r)
        assert max(held.values()) <= capacity
        for i, n in count.items():
            if n:
                p = sorted(parts[i], key=lambda r: r.part)
                assert sum(r.n_tokens for r in p) == n and [r.start_token for r in p] == [k * capacity for k in range(len(p))]
                assert len(p) == -(-n // capacity)
        assert sum(held.values()) / (len(held) * capacity) > 0.95
    assert {r.spec_id for r in out} == {1, 2}
    assert packing.pack_texts(df.limit(0), spec).count() == 0


def test_bins_that_combine_no_further_stay(spark):
    df = spark.createDataFrame([(i, "word " * 20) for i in range(300)], "doc_id long, text string")
    spec = spark.createDataFrame([(1, 32), (2, 10_000)], "spec_id int, capacity_tokens int")
    out = packing.pack_texts(df, spec, slot_items=30)
    assert out.where("spec_id = 1").count() == 300 and out.where("spec_id = 1").select("container_id").distinct().count() == 300
    assert packing.fill_report(out, spec).where("spec_id = 2").first().n_containers == 1


@pytest.mark.parametrize("text", ["x" + " " * 10_001 + "y", "a " * 20_000, "word" * 5000, "\n" * 12_000, " " * 10_500 + "\n\t é!"])
def test_counts_equal_the_tokenizer(text):
    enc = packing.encoder()
    assert packing.count_tokens(enc, text) == len(enc.encode_ordinary(text))


ITEM = "Station Paerik logged the sweep at 559.8 ticks, slightly above what Thabraen saw on day 68 overall."


def test_leaks(spark):
    items = [(1, ITEM), (2, "one spike at 713"), (3, None), (4, "..."), (5, ITEM)]
    docs = [
        (10, f"Before. {ITEM.upper()} After."),
        (11, "x station​ paerik logged the sweep at 559 8 ticks slightly above y"),  # eleven words
        (12, "x station paerik logged the sweep at 559 8 ticks slightly above what"),
        (13, ITEM.replace("559.8", "12.7").replace("Paerik", "Zzyzx")),
        (14, "There is ONE spike, at 713!"),
        (15, None),
        (16, ""),
        (17, "filler " * 50_000 + ITEM + " filler" * 50_000),
    ]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, eval_id int")
    i = spark.createDataFrame([(*x, 0) for x in items], "eval_id long, text string, doc_id int")
    hits = leakage.template_hits(d, i)
    rows = leakage.leaked_items(hits).collect()
    found = {(r.doc_id, r.eval_id) for r in rows if r.n_exact > 0}
    assert found == {(10, 1), (10, 5), (12, 1), (12, 5), (14, 2), (17, 1), (17, 5)}
    assert {tuple(r) for r in leakage.verbatim_leaks(hits).collect()} == found
    other = {(r.doc_id, r.eval_id) for r in rows if r.n_exact == 0 and r.consistent}
    assert {(13, 1), (13, 5)} <= other
    for x, y in ((d.limit(0), i), (d, i.limit(0))):
        assert leakage.leaked_items(leakage.template_hits(x, y)).count() == 0


def test_one_to_one_stretches():
    a = "one two three four five six seven eight nine ten".split()
    assert leakage.consistent_stretch(a, a, 4) == (10, 10)
    assert leakage.consistent_stretch(["5", *a], ["8", *a], 4) == (11, 10)
    # the second 5 becomes another number: only what follows the first one, or precedes the second, maps one to one
    assert leakage.consistent_stretch(["5", *a[:4], "5", *a[4:]], ["8", *a[:4], "9", *a[4:]], 4) == (11, 10)
    assert leakage.consistent_stretch(["4711"], ["12"], 1) == (0, 0)
    assert leakage.consistent_stretch(["4711"], ["4711"], 1) == (1, 1)


def test_reparameterised_items_are_found(spark):
    """Items with other names, numbers and units in half of the documents: recall and precision."""
    rng = random.Random(21)
    plain = "the series rises slowly after a calm start and then falls back below its mean while noise stays low near end of record".split()
    name = lambda: "".join(rng.choices("bdgklmnprstvz", k=3)).capitalize() + rng.choice(["ar", "on", "ex", "il"])
    units = ["ticks", "volts", "frames", "knots"]
    frames = []
    for _ in range(30):
        w = rng.sample(plain, 16)
        frames.append(w[:3] + ["{n}"] + w[3:7] + ["{v}", "{u}"] + w[7:12] + ["{n}"] + w[12:])
    fill = lambda f: " ".join(f).format(n=name(), v=rng.randrange(9000), u=rng.choice(units))
    items = [(k, fill(f)) for k, f in enumerate(frames)]
    docs, want = [], set()
    for k in range(200):
        text = " ".join(rng.choices(plain, k=60)) + f". The probe saw {rng.randrange(99)} {rng.choice(units)} at {name()}. "
        if k % 2:
            e = rng.randrange(30)
            text += fill(frames[e]) + ". "
            want.add((k, e))
        docs.append((k, text + " ".join(rng.choices(plain, k=60))))
    hits = leakage.template_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "eval_id long, text string"))
    got = {(r.doc_id, r.eval_id) for r in leakage.leaked_items(hits).where("consistent").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["rise", "fall", "at", "17", "ticks", "Ada", "Bob", "noisy"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 20])))) for k in range(20)]
    docs = []
    for k in range(60):
        t = rng.choices(vocabulary, k=40)
        for _ in range(2):
            w = words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(w) - 11))
            t[5:5] = w[a : a + rng.choice([11, 12, 20])]
        docs.append((k, " ".join(t)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "eval_id long, text string")
    got = {(r.doc_id, r.eval_id) for r in leakage.leaked_items(leakage.template_hits(d, i)).where("n_exact > 0").collect()}
    want = set()
    for k, t in docs:
        dw = words(t)
        for e, x in items:
            w = words(x)
            n = min(12, len(w))
            grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if any(tuple(dw[j : j + n]) in grams for j in range(len(dw) - n + 1)):
                want.add((k, e))
    assert got == want and want


def make_documents(seed=9):
    rng = random.Random(seed)
    letters = "abcdefgh .\né\U0001f600"
    noise = lambda n: "".join(rng.choices(letters, k=n))
    passages = [noise(n) for n in (299, 300, 301, 350, 700)]
    footer = noise(280)
    docs = []
    for k in range(90):
        t = noise(rng.randint(0, 400))
        if rng.random() < 0.7:
            p = rng.choice(passages)
            t += p if rng.random() < 0.6 else p[: rng.randint(250, len(p))]
        docs.append(t + noise(rng.randint(0, 300)) + (footer if rng.random() < 0.4 else ""))
    docs += [docs[5]] * 25 + [passages[4]] * 3 + [None, "", "ab" * 400, "ba" * 300, "x" * 299, "x" * 300, "x" * 5000]
    return list(enumerate(docs))


@pytest.mark.parametrize("hot,window_rows", [(2, 7), (64, 20_000), (64, 3)])
def test_shared_spans_equal_brute_force(spark, hot, window_rows):
    docs = make_documents()
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, id int, text_key string").repartition(6)
    members, links, stretches = spans.shared_spans(df, hot=hot, small=10, window_rows=window_rows, chunk=window_rows * 50, segment=max(500, window_rows))
    runs = {}
    for k, t in docs:
        for s in range(len(t or "") - 299):
            runs.setdefault(t[s : s + 300], {}).setdefault(k, []).append(s)
    want, covered = set(), {}
    for where in runs.values():
        if len(where) > 1:
            ids = sorted(where)
            want |= {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}
            for k, starts in where.items():
                for s in starts:
                    covered.setdefault(k, set()).update(range(s, s + 300))
    got = [(r.doc_a, r.doc_b) for r in spans.span_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(members, stretches).collect()}
    assert share == {k: len(covered.get(k, ())) for k, t in docs if t and len(t) >= 300}


def test_windows_are_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for _ in range(40):
        h, row, least = rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.sort(rng.integers(0, 3, 60)), int(rng.integers(1, 9))
        want = set()
        for a in range(60):
            low, high = a, a
            while low > 0 and row[low - 1] == row[a] and h[low - 1] > h[a]:
                low -= 1
            while high < 59 and row[high + 1] == row[a] and h[high + 1] > h[a]:
                high += 1
            if high - low + 1 >= least:
                want.add((a, low, high))
        assert {tuple(map(int, w)) for w in zip(*spans.compact_windows(h, least, row))} == want


def test_stretches_and_shares_of_every_document(spark, tmp_path):
    from quillon.llm import queries as Q

    docs = make_documents()
    docs += [(90_001, None), (90_002, "short"), (90_003, ""), (90_004, "w" * 5 + "0123456789" * 40), (90_005, "0123456789" * 40 + "v")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = {}
    for k, t in docs:
        for s in range(len(t or "") - 299):
            runs.setdefault(t[s : s + 300], {}).setdefault(k, []).append(s)
    covered = {}
    for where in runs.values():
        if len(where) > 1:
            for k, starts in where.items():
                for s in starts:
                    covered.setdefault(k, set()).update(range(s, s + 300))
    want = set()
    for k, at in covered.items():
        want |= {(k, s, min(e for e in at if e >= s and e + 1 not in at) + 1) for s in at if s - 1 not in at}
    assert {tuple(r) for r in Q.p8_stretches(spark, str(tmp_path)).collect()} == want
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in Q.p8_shared(spark, str(tmp_path)).collect()}
    assert got == {k: (len(t or ""), len(covered.get(k, ())), round(len(covered.get(k, ())) / len(t), 6) if t else 0) for k, t in docs}


def test_repetitive_texts_stay_small(spark):
    docs = [(1, "x" * 300_000), (2, "y" + "x" * 200_000 + "z"), (3, "ab" * 50_000), (4, "q" + "ab" * 400)]
    members, links, stretches = spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), window_rows=1000)
    assert {(r.doc_a, r.doc_b) for r in spans.span_pairs(members, links).collect()} == {(1, 2), (3, 4)}
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(members, stretches).collect()}
    assert share == {1: 300_000, 2: 200_000, 3: 100_000, 4: 800}


def test_shared_spans_of_nothing(spark):
    members, links, stretches = spans.shared_spans(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert spans.span_pairs(members, links).count() == 0 and spans.shared_share(members, stretches).count() == 0
