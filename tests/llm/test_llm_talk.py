"""Quality scores, structure repair and the prefix trie against brute force."""
import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sieve.llm import nbsvm, repair, turntrie

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
CLASH = ("key", "copies", "audit", "node", "parent", "words", "n", "timed", "body", "initial", "score", "label", "h", "place")


def crc(text):
    return zlib.crc32(text.encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- structure repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def turn_id(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    """{conv: rows in order}; every conversation is there."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        if fate:
            out[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, turn_id(*r[1:])))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\f\r")
        out.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, turns) by a recursion over suffixes that compares (cost, audit)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    named = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, room):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if room:
            for new in ("u", "a"):
                if (state, new) in step:
                    cost, audit, turns = best(i, new, room - 1)
                    options.append((cost + 3, "I" + audit, (f"{named[new]}:", *turns)))
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 if marks[i] == "t" else 0
            cost, audit, turns = best(i + 1, state, 3)
            options.append((cost + 4, "D" + audit, turns))
            if marks[i] in "t.":
                if (state, role[:1]) in step:
                    cost, audit, turns = best(i + 1, step[state, role[:1]], 3)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}", *turns)))
                for new in ("u", "a"):
                    if (state, new) in step:
                        cost, audit, turns = best(i + 1, new, 3)
                        options.append((cost + extra + 3, "R" + audit, (f"{named[new]}:{text}", *turns)))
        return min(options, default=(1 << 60, "", ()), key=lambda o: o[:2])

    return best(0, "", 3)


def repaired(rows):
    out = {}
    for conv, own in damaged(rows).items():
        marks = faults(own)
        cost, audit, turns = cheapest(tuple(own), tuple(marks))
        times = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, sha("\n".join(turns)))
    return out


def as_result(rows):
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def odd_turns(seed, convs=60, longest=14):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(0, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "User"])
            text = rnd.choice(["a b.", "a b.", "cut", "", None, " \n", "why?", f"x{c}{t}!", "é.", "wait \x0b"])
            rows.append((c, rnd.choice([t, t, t + 5, None]) if t % 3 == 0 else t, role, text))
    rows += [(None, 0, "user", "hi."), (None, None, "user", "hi."), (None, 1, "assistant", "x.")]
    rows += [(7, 2, "user", "same.")] * 3
    return rows


def test_repair_equals_brute_force(spark):
    table = spark.read.parquet(f"{MID}/conversations.parquet")
    want = repaired([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    got = as_result(E.queries()["op12_structure_repair"](spark, MID).collect())
    assert got == want and len(got) == table.select("conv_id").distinct().count()
    assert all(GRAMMAR.fullmatch("") is not None and set(r[6]) <= set("KRDI") for r in got.values())


@pytest.mark.parametrize("segment_rows", [1, 3, 256])
def test_repair_of_odd_rows_in_segments_of_any_length(spark, segment_rows):
    rows = odd_turns(segment_rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(5)
    got = repair.repair(repair.damaged(df), segment_rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert as_result(got.collect()) == repaired(rows)


def test_repair_of_one_long_conversation(spark):
    rnd = random.Random(5)
    rows = [(3, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"text {t}.", f"cut {t}", "again."])) for t in range(700)]
    got = as_result(repair.repair(repair.damaged(spark.createDataFrame(rows, TURNS)), 64).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())
    import sys

    sys.setrecursionlimit(20_000)
    assert got == repaired(rows)


def test_path_integers_hold_the_exhaustive_minimum():
    """Every edit sequence of short conversations, written out."""
    def every(rows):
        for kinds in itertools.product("KRD", repeat=len(rows)):
            for gaps in itertools.product(range(3), repeat=len(rows) + 1):
                letters, roles, cost = "", "", 0
                ok = True
                for i, (k, row) in enumerate(zip(kinds, rows, strict=True)):
                    for _ in range(gaps[i]):
                        roles += "u" if roles[-1:] in ("", "s", "a") else "a"
                        letters, cost = letters + "I", cost + 3
                    letters += k
                    if k == "D":
                        cost += 4
                    elif row[1] == "d":
                        ok = False
                    else:
                        roles += row[0] if k == "K" else "u" if roles[-1:] in ("", "s", "a") else "a"
                        cost += (3 if k == "R" else 0) + (3 if row[1] == "t" else 0)
                for _ in range(gaps[-1]):
                    roles += "u" if roles[-1:] in ("", "s", "a") else "a"
                    letters, cost = letters + "I", cost + 3
                if ok and GRAMMAR.fullmatch(roles):
                    yield cost, letters

    rnd = random.Random(1)
    for _ in range(120):
        rows = [rnd.choice("suax") + rnd.choice("..td") for _ in range(rnd.randint(1, 4))]
        path = repair.Path()
        for cut in range(0, len(rows), 2):
            path.add(list(repair.segment("".join(rows[cut : cut + 2]))))
        assert path.finish() == min(every(rows)), rows


def test_repair_without_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_damaged(empty).collect() == []
    gone = next(t for t in range(200) if crc(f"1:{t}") % 20 == 0)
    r = repair.repair_damaged(spark.createDataFrame([(1, gone, "user", "x.")], TURNS)).collect()
    assert as_result(r) == {1: (0, 0, 0, 0, 0, 0, "", sha(""))}


# ---------------------------------------------------------------- prefix trie

def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_id(role or "", text or ""), role or "", text or ""))
    own = {c: [r[3:] for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc(str(c)) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    return out


def trie(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        words = len(re.findall("[^ \t\n\x0b\f\r]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in below)
    return sorted((min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), len(children.get(node, [])), leaves[node], saved[node],
                   sha(",".join(str(c) for c in sorted(own) if convs[c] == node))) for node, own in members.items())


def as_nodes(rows):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *(r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))) for r in rows)


def test_trie_equals_brute_force(spark):
    table = spark.read.parquet(f"{MID}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert as_nodes(E.queries()["op13_prefix_trie"](spark, MID).collect()) == trie(rows)


@pytest.mark.parametrize("stretch_bytes", [1, 300, 1 << 22])
def test_trie_of_odd_rows_in_stretches_of_any_size(spark, stretch_bytes):
    rnd = random.Random(stretch_bytes)
    rows = []
    for c in range(240):
        for t in range(rnd.randint(0, 6)):
            text = rnd.choice(["a", "b c", "d e f", "", None]) if t < 4 else rnd.choice([f"x{c}", "y"])
            rows.append((c, rnd.choice([t, None]) if t == 0 else t, rnd.choice(["user", "user", None]), text))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 330) for t in range(9)]  # copies
    rows += [(c, t, "user", "wide" if t < 5 else f"{c}") for c in range(400, 700) for t in range(6)]  # a node of many children
    rows += [(None, 0, "user", "left out"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(4)
    got = turntrie.trie(turntrie.rebuilt(turntrie.turns_of(df)), stretch_bytes)
    assert as_nodes(got.collect()) == trie(rows)


def test_trie_without_rows(spark):
    assert turntrie.of_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_tree_layouts_keep_every_key():
    rnd = random.Random(3)
    for alphabet in (3, 20, 60, 256):
        keys = sorted({bytes(rnd.randrange(alphabet) for _ in range(16 * rnd.randint(0, 3))) for _ in range(600)})
        root, found, todo = turntrie.tree(keys), [], []
        todo.append((root, b""))
        sizes = set()
        while todo:
            node, at = todo.pop()
            sizes.add(256 if not node.bytes and node.children else len(node.bytes))
            if node.entry is not None:
                found.append((at, node.entry))
            below = [(b, node.child(b)) for b in range(256)]
            below = [(b, c) for b, c in below if c is not None]
            assert [c for _, c in below] == node.ordered()
            todo += [(c, at + bytes([b]) + c.path) for b, c in below]
        assert sorted(found) == [(k, i) for i, k in enumerate(keys)]
        if alphabet == 256:
            assert 256 in sizes


# ---------------------------------------------------------------- quality

def test_quality_on_held_out_labels(spark):
    got = E.queries()["op11_nb_svm"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    up, down = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert ((up[:, None] > down[None, :]).mean() + (up[:, None] == down[None, :]).mean() / 2) > 0.97
    assert (got.predicted == got.quality).mean() > 0.95 and (got[got.quality == 1].predicted == 1).mean() > 0.97
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_learns_only_from_the_other_folds(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(nbsvm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r.doc_id, r.score) for r in nbsvm.judge(df[0], df[1]).collect())
    plain = key((docs, labels))
    assert plain == key((docs, turned)) == key((docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")), labels))


def test_dual_descent_reaches_the_primal_optimum():
    """Duality gap of the hinge fit on random sparse rows."""
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(60, 8, replace=False)), rng.normal(size=8)) for _ in range(80)]
    label = np.array([int(v.sum() + rng.normal() > 0) for _, v in rows])
    w, b = nbsvm.hinge_fit(rows, label, epochs=2000)
    sign = np.where(label == 1, 1, -1)
    x = np.zeros((80, 61))
    for i, (at, v) in enumerate(rows):
        x[i, at], x[i, 60] = v, 1
    full = np.append(w[:60], b)
    primal = full @ full / 2 + np.maximum(0, 1 - sign * (x @ full)).sum()
    # any other point is no better
    for _ in range(300):
        other = full + rng.normal(size=61) * 10.0 ** rng.uniform(-4, -1)
        assert other @ other / 2 + np.maximum(0, 1 - sign * (x @ other)).sum() >= primal - 1e-6


def test_quality_of_odd_rows(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "good words here.", "en", "s", 1), (1, "good words here.", "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "bad!! BAD!!", "en", "s", 1),
            (4, "x " * 500_000, "en", "s", 1), (5, " \n", "en", "s", 1), (6, "BAD!! words!!", "en", "s", 1), (8, "more good words.", "en", "s", 1), (9, "😀 é", "en", "s", 1)]
    rows = [(i, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t, *r) for i, t, *r in rows]
    docs = spark.createDataFrame(rows, columns).withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (3, 0, 0), (5, 1, 0), (6, 0, 0), (6, 1, 0), (8, 1, 0), (None, 1, 0), (4, 7, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1"), labels.filter("quality = 0")):
        got = nbsvm.judge(docs, some).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        one = {r.score for r in got if r.doc_id in (2, 3, 5)}
        assert len(one) == 1  # no n-grams: the bias
    assert nbsvm.judge(docs.limit(0), labels).collect() == []
    assert {r.score for r in nbsvm.judge(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_sample_is_bounded_and_even(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2900).cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("quality"))
    few, many = nbsvm.sample(docs, labels, 400)
    rows = few.collect()
    assert len(rows) == 400 and sum(r.label for r in rows) == 200 and sum(many) == 2900 and len({r.h for r in rows}) == 400
    few, many = nbsvm.sample(docs, labels, 1000)
    rows = few.collect()
    assert len(rows) == 1000 and sum(r.label for r in rows) == many[1] == 290
