"""Corpus operators against brute force, round trips and held-out rows, with awkward inputs."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import chat, components, decontaminate, licenses, merkle, mixing, queries, quality, simhash, substring, toxicity, training, warc
from peakloom.llm.common import WordNames
from tests.conftest import DATA, canon

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None if k % 3 == 0 else f"s{k % 3}", None if t is None else len(t), "x", 1) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


LONG = " ".join(f"w{k * k % 977}" for k in range(3000))
VERY_LONG = "\n".join(" ".join(f"v{k * j % 7919}" for k in range(12)) for j in range(40_000))  # over a chunk of 2 MiB
AWKWARD = [None, "", "   \n\t ", "one", "one two", LONG, LONG, LONG + " tail", "ÄÖ ß x 中文 😀 " * 40, "a " * 300, "x\n\n\ny\n"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_merkle_fingerprint", "op4_benchmark_decontamination", "op8_substring_dedup"])
@pytest.mark.parametrize("ids", [None, [None, 3, 3, 1, 1, 7, 7, 2, None, 9, 4]])
def test_awkward_documents_equal_sql(spark, name, ids):
    import duckdb

    if name == "op3_merkle_fingerprint" and ids:
        ids = [None, 3, 3, 1, 1, 7, 7, 2, 11, 9, 4]
    own = docs(spark, AWKWARD, ids)
    bench = spark.createDataFrame([(1, "one"), (2, None), (None, "w0 w1 w4 w9 w16 w25 w36 w49 w64"), (4, ""), (4, "中文 x ß")], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", own.toArrow())
    con.register("benchmark", bench.toArrow())
    run = {
        "op2_license_scan": lambda: licenses.scan(own, licenses.known_digests(spark)), "op3_merkle_fingerprint": lambda: merkle.fingerprint_edits(own),
        "op4_benchmark_decontamination": lambda: decontaminate.report(own, bench), "op8_substring_dedup": lambda: substring.report(own),
    }[name]
    assert canon(run().toPandas()) == canon(con.sql(queries.ORACLES[name]).df())


def test_a_text_longer_than_a_chunk(spark):
    own = docs(spark, ["short one", VERY_LONG, VERY_LONG, ""])
    assert len(VERY_LONG) > 2 << 20
    words = VERY_LONG.split()
    bench = spark.createDataFrame([(1, " ".join(words[-9:]))], "item_id long, text string")
    prints = [r.fingerprint for r in simhash.near_duplicates(own).orderBy("doc_id").collect()]
    assert prints[1] == prints[2] == f"{slow_simhash(VERY_LONG):016x}"
    cut = [(r.n_words, r.n_removed) for r in substring.report(own).orderBy("doc_id").collect()]
    assert cut == [(2, 0), (len(words), slow_repeats([VERY_LONG], [0])[0]), (len(words), len(words)), (0, 0)]
    hits = [(r.n_words, r.n_hit > 0) for r in decontaminate.report(own, bench).orderBy("doc_id").collect()]
    assert hits == [(2, False), (len(words), True), (len(words), True), (0, False)]
    tree = [(r.n_chars, r.edited_sha256) for r in merkle.fingerprint_edits(own).orderBy("doc_id").collect()]
    half = len(VERY_LONG) // 2
    assert tree[1] == (len(VERY_LONG), hashlib.sha256((VERY_LONG[: len(VERY_LONG) - half] + VERY_LONG[:half]).encode()).hexdigest())
    assert [r.license_id for r in licenses.scan(own, licenses.known_digests(spark)).collect()] == [None] * 4


def test_empty_tables(spark):
    none, labels = docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string, html string")
    some = docs(spark, ["a b c", None])
    for got in (
        simhash.near_duplicates(none), licenses.scan(none, licenses.known_digests(spark)), merkle.fingerprint_edits(none), decontaminate.report(none, bench), mixing.mix(none), substring.report(none),
        quality.report(none, labels), toxicity.report(none, labels), warc.report(pages), chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert got.count() == 0
    assert decontaminate.report(some, bench).where("n_hit > 0").count() == 0
    assert {r.score for r in quality.report(some, labels).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in toxicity.report(some, labels).collect())


# op1

def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_definition():
    for t in AWKWARD:
        assert simhash.simhash((t or "").encode()) == slow_simhash(t)
    assert simhash.simhash("The cat\tSAT on".encode()) == slow_simhash("the cat sat on")


def closure(prints, limit):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("sizes", [{}, {"LEAF_ROWS": 8, "CELL_ROWS": 16}, {"TREE_SAMPLE": 64, "SUBTREE_SAMPLE": 64, "LEAF_ROWS": 8, "LEAF_SAMPLE": 4, "SPLIT_ROWS": 24, "CELL_ROWS": 16}])
def test_near_links_equal_all_pairs(spark, monkeypatch, sizes):
    """The last case splits shards by subtrees in several rounds."""
    for name, value in sizes.items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 250, dtype=np.int64).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in np.repeat(base[:60], 4)]
    prints = sorted({*map(int, base), *near, 0, (1 << 64) - 1, 7})
    own = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    got = closure_of(prints, [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in simhash.near_links(own).collect()])
    assert got == closure(prints, 3)


def closure_of(nodes, pairs):
    root = {p: p for p in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(int(a)), find(int(b))
        root[max(x, y)] = min(x, y)
    return {p: find(p) for p in nodes}


def test_tree_reaches_every_neighbor():
    rng = np.random.default_rng(9)
    points = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    tree = simhash.Tree(points[:1500], 40)
    leaf = dict(zip(*map(np.ndarray.tolist, tree.reach(points, 0))))
    moved = points ^ (np.uint64(1) << rng.integers(0, 32, 3000, dtype=np.uint64))
    reached = set(zip(*map(np.ndarray.tolist, tree.reach(moved, 1))))
    assert tree.n_leaves > 20 and all((k, leaf[k]) in reached for k in range(3000))


def test_near_duplicates(spark):
    ids = [5, 6, 7, 8, 9, 4, 30, 2, 3, None, 1]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs(spark, AWKWARD, ids)).collect()}
    prints = {(i, f"{slow_simhash(t):016x}") for i, t in zip(ids, AWKWARD)}
    assert set(got) == prints and got[4, f"{slow_simhash(LONG):016x}"] == got[30, f"{slow_simhash(LONG):016x}"]
    root = closure([int(p, 16) for _, p in prints], 3)
    for (i, p), c in got.items():
        assert c == min((j for j, q in prints if j is not None and root[int(q, 16)] == root[int(p, 16)]), default=None)
    kept = simhash.representatives(docs(spark, AWKWARD, ids))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for (i, _), c in got.items() if c == i})


def test_one_row_of_each_component_stays(spark):
    far = " ".join(f"y{k * k % 613}" for k in range(400))
    texts = [LONG, LONG, LONG, LONG + " tail", far, far, None, None, ""]
    kept = simhash.representatives(docs(spark, texts, [3, 3, 5, 3, None, None, 8, 8, None])).collect()
    assert len(kept) == 3 and [r.doc_id for r in kept if r.text == far] == [None] and [r.doc_id for r in kept if not r.text] == [8]
    assert [r.doc_id for r in kept if (r.text or "").startswith(LONG)] == [3]


def test_whole_query_equals_brute_force(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    got, text = {r.doc_id: r for r in queries.op1_simhash_dedup(spark, DATA).collect()}, {r.doc_id: r.text for r in own.collect()}
    prints = {i: slow_simhash(t) for i, t in text.items()}
    root = closure(sorted(set(prints.values())), 3)
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 500), (700, 600), (600, 700)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {700: 600}


# op2

def test_licenses(spark, monkeypatch):
    known = dict(reversed(licenses.known_texts()))  # of a licence with and without its title the latter
    mit = known["MIT"]
    texts = ["Copyright (c) 2020 A B\n" + mit.upper().replace(",", " ;"), "x\n  released under the MIT licence!\ny", mit + " more", None, "MIT License\n\n" + mit, *(known[k] for k in ("GPL-3.0", "Apache-2.0", "BSD-3-Clause"))]
    want = [("MIT", ""), (None, "MIT-notice"), (None, ""), (None, ""), ("MIT", ""), ("GPL-3.0", ""), ("Apache-2.0", ""), ("BSD-3-Clause", "")]
    for limit in (licenses.INLINE_ROWS, 3):  # looked up in place, then joined
        monkeypatch.setattr(licenses, "INLINE_ROWS", limit)
        got = [(r.doc_id, r.license_id, r.notices) for r in licenses.scan(docs(spark, texts), licenses.known_digests(spark)).orderBy("doc_id").collect()]
        assert got == [(k, *w) for k, w in enumerate(want)]
    assert licenses.scan(docs(spark, texts), licenses.known_digests(spark, [])).where("license_id IS NOT NULL OR notices <> ''").count() == 0


# op3

def test_merkle_locates_edits(spark):
    a = docs(spark, ["one\ntwo\n\nthree\nfour", "same", "gone"], [1, 2, 3])
    b = docs(spark, ["one\ntwo\n\nTHREE\nfour", "same"], [1, 2])
    got = [tuple(r) for r in merkle.edits(merkle.tree(a), merkle.tree(b)).orderBy("doc_id").collect()]
    assert got == [(1, 1, 0)]
    t = {r.doc_id: r.root for r in merkle.tree(a).collect()} | {10 + r.doc_id: r.root for r in merkle.tree(b).collect()}
    assert t[2] == t[12] and t[1] != t[11]


@pytest.mark.parametrize("most", [1, 3, 100])
def test_merkle_order_reaches_over_blocks(spark, monkeypatch, most):
    """Dense ids, ids as sparse as hashes, an id that many rows repeat and rows that are all the same."""
    monkeypatch.setattr(merkle, "BLOCK_BYTES", 40)
    monkeypatch.setattr(merkle, "MOST_BLOCKS", most)
    rng = np.random.default_rng(3)
    ids = [-9, -1, *range(60), *rng.integers(-(1 << 62), 1 << 62, 60).tolist(), *[7] * 50, *[8] * 50, 1 << 40]
    texts = [f"t{k}" if i != 8 else "same" for k, i in enumerate(ids)]
    rows = spark.createDataFrame(list(zip(ids, texts)), "k long, text string")
    got = sorted((r.k, r.text, r.next_text) for r in merkle.with_next(rows).collect())
    order = sorted(zip(ids, texts), key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()[:15]))
    assert got == sorted((*a, b[1]) for a, b in zip(order, order[1:] + order[:1]))


def test_likeness_goes_down_differing_branches(spark):
    s = [f"Sentence number {k} of this text." for k in range(9)]
    base = f"{s[0]}{s[1]}\n{s[2]}\n\n{s[3]}\n\n{s[4]}"
    other = f"{s[0]}{s[1]}\n{s[5]}\n\n{s[3]}\n\n{s[6]}{s[4]}"
    rows = merkle.tree(docs(spark, [base, base, base, base, ""])).withColumnRenamed("fingerprint", "f").join(merkle.tree(docs(spark, [base, other, s[8], "", ""])).select("doc_id", "fingerprint"), "doc_id")
    got = [r.near for r in merkle.compared(rows, "f", "fingerprint", "near").orderBy("doc_id").collect()]
    assert got == pytest.approx([1, 2 * 4 / 11, 0, 0, 1])


def test_merkle_likeness(spark):
    rows = merkle.fingerprint_edits(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    long = rows[rows.n_chars > 200]
    assert (long.near_edited > long.near_next).mean() > 0.95 and rows.near_edited.between(0, 1).all()


# op4

def test_fm_index_equals_search():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 400)
    index = decontaminate.FMIndex(text)
    patterns = np.array([text[k : k + 4] for k in range(0, 396, 7)] + [[9, 9, 9, 9], [1, 1, 1, 1]])
    pattern, place = index.find(patterns)
    want = {(i, j) for i, p in enumerate(patterns) for j in range(397) if (text[j : j + 4] == p).all()}
    assert set(zip(pattern.tolist(), place.tolist())) == want and len(pattern) == len(want)


def test_benchmark_in_blocks(spark, monkeypatch):
    own, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = canon(decontaminate.report(own, bench).toPandas())
    cleaned = canon(decontaminate.clean(own, bench).toPandas())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 20_000)
    assert canon(decontaminate.report(own, bench).toPandas()) == want and canon(decontaminate.clean(own, bench).toPandas()) == cleaned


def test_clean_cuts_spans(spark):
    item, other = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    own = docs(spark, [f"Keep, this! {item.upper()}; and this.", f"{item} {other}", "nothing here", None])
    got = {r.doc_id: r for r in decontaminate.clean(own.select(*corpus_pipeline.COLUMNS), spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")).collect()}
    assert set(got) == {0, 2, 3} and got[0].text == "Keep, this! ; and this." and got[0].n_chars == len(got[0].text) and got[2].text == "nothing here" and got[3].text is None


# op5

def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    m = chat.Model(rng.random(6), rng.random((6, 6)), rng.random((6, 8)))
    codes = rng.integers(0, 8, 5).tolist()

    def score(path):
        return m.start[path[0]] + m.emit[path[0], codes[0]] + sum(m.move[a, b] + m.emit[b, c] for a, b, c in zip(path, path[1:], codes[1:]))

    best = max(itertools.product(range(6), repeat=5), key=score)
    assert m.decode(codes) == list(best)
    assert m.transfer(codes)[-1].max() == pytest.approx(score(best))


def test_chat_is_the_same_in_any_partitioning(spark):
    talk = spark.read.parquet(f"{DATA}/conversations.parquet")
    one = talk.withColumn("conv_id", F.when(F.col("conv_id") % 3 == 0, 7).otherwise(F.col("conv_id"))).withColumn("turn", F.col("turn") + 100 * F.col("conv_id"))
    raw = chat.transcript(one)
    model, results = chat.train(raw), []
    for n in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            results.append(canon(chat.format_chats(raw, model).toPandas()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] and len(results[0]) == talk.count()


def slow_chats(rows, model):
    """Whole conversations one after the other: plain marker search, plain Viterbi, plain rendering."""
    names = {n.lower(): r for r, own in (("system", ["system", "instructions", "### system", "context"]), ("user", ["user", "human", "### user", "q"]), ("assistant", ["assistant", "ai", "### assistant", "a"])) for n in own}

    def marker(line):
        low = line.lstrip()
        for n in sorted(names, key=len, reverse=True):
            if low.lower().startswith(n):
                rest = low[len(n) :].lstrip()
                if rest.startswith(":"):
                    return names[n], rest[1:].lstrip()
                if not rest:
                    return names[n], ""
        return None, line

    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        lines = [(r[1], line) for r in own for line in r[2].split("\n")]
        codes, blank = [], True
        for _, line in lines:
            role, _ = marker(line)
            size = len(line.strip())
            codes.append(((0 if role is None else 1 + chat.ROLES.index(role)) * 2 + blank) * 4 + (size >= 1) + (size >= 60) + (size >= 160))
            blank = size == 0
        best = [[model.start[s] + model.emit[s, codes[0]] for s in range(6)]]
        came = []
        for c in codes[1:]:
            came.append([max(range(6), key=lambda a: (best[-1][a] + model.move[a, b], -a)) for b in range(6)])
            best.append([best[-1][came[-1][b]] + model.move[came[-1][b], b] + model.emit[b, c] for b in range(6)])
        path = [max(range(6), key=lambda s: (best[-1][s], -s))]
        for c in reversed(came):
            path.append(c[path[-1]])
        path.reverse()
        for r in own:
            shown, roles, n = [], [], 0
            for (turn, line), s in zip(lines, path):
                if turn != r[1]:
                    continue
                n += 1
                if s % 2 == 0:
                    roles.append(chat.ROLES[s // 2])
                    shown.append(f"<|{roles[-1]}|>")
                    line = marker(line)[1]
                shown.append(line)
            out[r[0], r[1]] = (n, ",".join(roles), "\n".join(shown).strip("\n"))
    return out


def test_chats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    talk = spark.read.parquet(f"{DATA}/conversations.parquet").where("conv_id < 40")
    long = talk.select(F.lit(10_000).cast("long").alias("conv_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("turn"), "role", "text")  # one of many partitions
    raw = chat.transcript(talk.select("conv_id", "turn", "role", "text").unionByName(long))
    model = chat.train(raw)
    rows = [(r.conv_id, r.turn, r.raw) for r in raw.collect()]
    got = {(r.conv_id, r.turn): (r.n_lines, r.roles, r.rendered) for r in chat.format_chats(raw, model).collect()}
    assert got == slow_chats(rows, model) and len(got) == len(rows)


def test_chat_recovers_roles_of_held_out_conversations(spark):
    talk = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.report(talk).join(talk, ["conv_id", "turn"]).where(chat.held_out())
    assert got.count() > 50 and got.agg(F.avg((F.col("roles") == F.col("role")).cast("double"))).head()[0] > 0.95
    sample = got.where("roles = role").head()
    assert sample.rendered == f"<|{sample.role}|>\n{sample.text}".rstrip("\n")


def test_held_out_conversations_are_not_counted(spark):
    raw = chat.transcript(spark.read.parquet(f"{DATA}/conversations.parquet"))
    other = raw.withColumn("role", F.when(chat.held_out(), "user").otherwise(F.col("role")))
    assert all((x == y).all() for x, y in zip(vars(chat.train(raw)).values(), vars(chat.train(other)).values()))


def test_awkward_chats(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 1, "user", "hello"), (1, 1, "user", "hello"), (1, None, "tool", ""), (2, 1, "assistant", "x" * 300_000), (2, 2, "user", "\n\n\n")]
    got = chat.report(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string"))
    assert got.columns == ["conv_id", "turn", "n_lines", "roles", "rendered"] and sorted(map(str, ((r.conv_id, r.turn) for r in got.collect()))) == sorted(str(r[:2]) for r in rows)


# op6

def test_warc_round_trip(spark):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a", big, 0), (2, None, big, 0), (3, "http://c", "x" * 999, 0), (4, "http://d", "x" * 999, 0), (5, "u", None, 0), (None, "n", big, 0), (6, "six", big + "!", 0)], "page_id long, url string, html string, payload_digest int")
    got = {r.page_id: r for r in warc.archive(pages).collect()}
    assert [got[k].record_type for k in (1, 2, 3, 4, 5, 6, None)] == ["revisit", "response", "response", "response", "response", "response", "revisit"]
    assert got[1].refers_to == 2 and got[None].refers_to == 2 and got[2].refers_to is None and got[1].payload_bytes == 1200 and got[1].payload is None
    assert bytes(got[2].payload).decode() == big and got[5].payload_bytes == 0 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()


def test_warc_files(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").coalesce(1)
    warc.write(warc.deduplicated(pages).coalesce(1), str(tmp_path / "w"), 40)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) == 2 and all(f[:4] == b"\x5d\x2a\x4d\x18" for f in files)
    assert sum(1 for f in files for _ in warc.parse(f)) == pages.count()
    assert sum(map(len, files)) < 0.6 * sum(len(r.html.encode()) for r in pages.collect())


def test_warc_archives_end_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "<p>" + "word %d " % k * 400, 0) for k in range(30)], "page_id long, url string, html string, payload int").coalesce(1)
    rows = warc.deduplicated(pages).coalesce(1)
    warc.write(rows, str(tmp_path / "w"), 40, 10_000)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) >= 8 and all(f[:4] == b"\x5d\x2a\x4d\x18" and f.count(b"\x5d\x2a\x4d\x18") == 1 for f in files)
    assert {(r.page_id, bytes(r.payload)) for r in warc.read(spark, str(tmp_path / "w")).collect()} == {(r.page_id, r.html.encode()) for r in pages.collect()}


# op7

def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
            capped.add(s)
            left -= target[s]


def test_mixing(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(n)), None, [None, "b", "a", "é", "Z", "empty"][k % 5 if n else 5], 0) for k, n in enumerate(rng.integers(0, 400, 3000))]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(own).join(own.select("doc_id", "source"), "doc_id").toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if s != s or s is None else s: int(v) for s, v in sizes.items()}
    want = slow_targets(sizes)
    assert len(got) == 3000 and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for s, part in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert part.target.iloc[0] == pytest.approx(want[s]) and abs(part.taken.sum() - want[s]) <= 5
    again = mixing.mix(own.repartition(7)).toPandas()
    assert canon(again) == canon(got[again.columns.tolist()])


def test_small_sources_beside_a_large_one(spark):
    """A source of one block lands with its whole reserve while another source still has several blocks."""
    rng = np.random.default_rng(7)
    rows = [(k, "big", int(n)) for k, n in enumerate(rng.integers(1, 400, 5000))]
    for j in range(20):
        rows += [(10_000 + 100 * j + k, f"s{j:02}", int(n)) for k, n in enumerate([*rng.integers(1, 400, 40), *rng.integers(2000, 20_000, 10)])]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows) and got.copies.isin([0, 1, 2]).all()
    for _, part in got.groupby("source"):
        assert abs((part.copies * part["size"]).sum() / part.target.iloc[0] - 1) <= 0.01


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    sizes, p = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37)
    out = mixing.flight(p, sizes, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(p.sum()) and (out * sizes).sum() == pytest.approx((p * sizes).sum())


# op8

def slow_repeats(texts, ids):
    words = [(t or "").split() for t in texts]
    least = {}
    for w, i in zip(words, ids):
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            least[g] = min(least.get(g, i), i)
    out = []
    for w, i in zip(words, ids):
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append(len(gone))
    return out


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n, v: [f"v{x}" for x in rng.integers(0, v, n)]
    shared, texts = word(260, 4000), []
    for k in range(60):
        a, b = sorted(rng.integers(0, 260, 2))
        texts.append(" ".join(word(int(rng.integers(0, 90)), 300) + shared[a:b] + word(int(rng.integers(0, 90)), 300)))
    texts += ["a " * n for n in (49, 50, 51, 120)] + ["a b " * n for n in (24, 25, 40)] + ["a a b " * 30, "c " * 60 + "d " * 60, "x " + "c " * 60 + "d " * 55, " ".join(shared), " ".join(shared)]
    texts += ["q r " * 300, "x " * 7 + "q r " * 200 + " ".join(shared[:70]), "r q r s " * 90 + "q r " * 60, "q r s r " * 80]
    ids = rng.permutation(len(texts)).tolist()
    got = {r.doc_id: r.n_removed for r in substring.report(docs(spark, texts, ids)).collect()}
    assert [got[i] for i in ids] == slow_repeats(texts, ids)


def test_a_text_of_few_words_has_few_segments():
    texts = [b"q r " * 2000, b"", b"s t u " * 500 + b"q r " * 100]
    batch = pa.RecordBatch.from_pydict({"id": [3, 1, 2], "print": [0, 0, 0], "text": pa.array(texts, pa.binary())})
    out = next(substring._parse(iter([batch]))).to_pylist()
    assert [r["id"] for r in out] == [3, 1, 2] and out[1]["segments"] == [] and len(out[0]["segments"]) <= 4
    for text, row in zip(texts, out):
        spans = sorted(divmod(x, 1 << 32) for s in row["segments"] for x in s["spans"])
        assert [k for low, high in spans for k in range(low, high + 1)] == list(range(max(0, len(text.split()) - 49)))
        assert len({(s["key"], s["hash"]) for s in row["segments"]}) == len(row["segments"])


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(6)
    middle = [b"%d" % x for x in rng.integers(0, 3, 90)]
    docs_ = [[b"%d" % x for x in rng.integers(0, 3, int(n))] + middle + [b"%d" % x for x in rng.integers(0, 3, int(n) % 17)] for n in rng.integers(0, 80, 40)] + [[b"a"] * 200]
    parsed = substring.Parsed(docs_, WordNames(1))
    keys, seen = parsed.keys(), {}
    for w, o, k in zip(parsed.window, parsed.owner, keys):
        at = w - parsed.starts[o]
        assert seen.setdefault(tuple(docs_[o][at : at + 50]), k) == k


# op9 and op10

def held_out(spark, module, label, mod, hold):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = module.report(own, labels).join(labels, "doc_id").toPandas()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % mod == hold) for i, h in zip(got.doc_id, got.held_out))
    return got[got.held_out], label


def test_quality_on_held_out_rows(spark):
    got, label = held_out(spark, quality, "quality", 5, 0)
    assert got.score.between(0, 1).all() and (got.predicted == got[label]).mean() > 0.9


def test_toxicity_on_held_out_rows(spark):
    got, label = held_out(spark, toxicity, "toxic", 3, 1)
    assert (got.predicted == got[label]).mean() > 0.9
    hit = got[(got.predicted == 1)]
    assert all(len(o) for o in hit.offsets)


def test_labels_of_held_out_rows_are_not_read(spark):
    own, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(training.fold(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(training.fold(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    for module in (quality, toxicity):
        assert canon(module.report(own, labels).toPandas()) == canon(module.report(own, other).toPandas())


def test_copies_count_once_among_markers():
    rng = np.random.default_rng(12)
    text = lambda n=30: [b"w%d" % x for x in rng.integers(0, 900, n)]
    clean, one = [text() for _ in range(300)], text()
    copies = [one + [b"vile"]] * toxicity.SUPPORT * 2
    apart = [text() + [b"common", b"vile"] for _ in range(toxicity.SUPPORT)]
    marked = lambda toxic: toxicity.markers(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    assert b"wvile" not in marked(copies) and {b"wvile", b"pvile", b"wcommon"} <= marked(apart)
    assert marked([[], []]) == toxicity.markers([], []) == set()


def test_chains_equal_plain_recursion():
    rng = np.random.default_rng(7)
    lengths = np.array([1, 0, 300, 128, 129, 5, 1000])
    odds, a, start = np.exp(rng.normal(0, 2, lengths.sum())), np.exp(rng.normal(0, 1, (2, 2))), 0.3
    forward, backward = toxicity.Chains(lengths).marginals(odds, start, a)
    at = 0
    for n in lengths:
        e, f, b = odds[at : at + n], np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            f[t] = (np.array([1, start]) if t == 0 else f[t - 1] @ a) * [1, e[t]]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (b[t + 1] * [1, e[t + 1]])
            b[t] /= b[t].sum()
        assert np.allclose(forward[at : at + n] * backward[at : at + n], f[:, 1] * b[:, 1] / (f[:, 0] * b[:, 0]))
        at += n


def test_offsets_are_the_tagged_words():
    text = "Ab, ß9 x!".encode()
    assert [text[a:b].decode() for a, b in toxicity.token_spans(text)] == ["Ab", "ß9", "x"]


# pipeline

def test_pipeline_stage_by_stage(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k.split()[0] for k in stages] == ["toxicity", "simhash", "substring", "benchmark", "source"]
    steps, current = [], own
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        current = stage(spark, current, DATA).checkpoint()
        steps.append(current)
        if k < 4:
            assert current.columns == own.columns and [t for _, t in current.dtypes] == [t for _, t in own.dtypes]
    toxic = toxicity.report(own, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in steps[0].collect()} == {r.doc_id for r in toxic.where("predicted = 0").collect()}
    kept = simhash.near_duplicates(steps[0]).where("doc_id = component_id")
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted({r.doc_id for r in kept.collect()})
    cut = {r.doc_id: r for r in substring.without_repeats(steps[1]).collect()}
    before = {r.doc_id: r.text for r in steps[1].collect()}
    for r in steps[2].collect():
        assert r.text == (before[r.doc_id] if not cut[r.doc_id].n_removed else bytes(cut[r.doc_id].kept).decode()) and r.n_chars == len(r.text)
    leaks = {r.doc_id: len(r["items"]) for r in decontaminate.leaks(steps[2], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in steps[3].collect()} == {k for k, n in leaks.items() if n < 2}
    taken = {r.doc_id: r.taken for r in mixing.mix(steps[3]).where("taken > 0").collect()}
    assert {r.doc_id: r.taken for r in steps[4].collect()} == taken


def test_stages_pass_awkward_rows(spark, tmp_path):
    own = docs(spark, AWKWARD, [None, 3, 3, 1, 1, 7, 7, 2, 11, 9, 4])
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:5] == list(corpus_pipeline.COLUMNS)
