"""Prefix tries, Merkle manifests and web archives against plain versions, and the cases that their docstrings define."""

import collections
import gzip
import hashlib
import io
import random
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, merkle, mixing, prefix_trie, warc
from tessella.llm.sql import SQL

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
PAGES = "page_id long, url string, html string"


def by_sql(name, table, schema, rows):
    """What the query's SQL makes of rows."""
    con = duckdb.connect()
    kinds = schema.replace("long", "BIGINT").replace("string", "VARCHAR")
    con.execute(f"CREATE TABLE {table} ({kinds})")
    if rows:
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    out = con.execute(SQL[name])
    names = [c[0] for c in out.description]
    return collections.Counter(tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names)) for r in out.fetchall())


def counted(df):
    names = sorted(df.columns)
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


# ---- conversations


def plain_trie(rows):
    """Nodes by their turns themselves."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    members, last = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        last[tuple(whole)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ended = lambda p: hashlib.sha256(",".join(map(str, sorted(last[p]))).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ended(p)) for p, m in members.items())


def nodes(df):
    out = prefix_trie.of_blocks(df)
    return collections.Counter(tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in sorted(rng.sample(range(-150, 450), n)):
        turns = rng.randint(0, longest)
        for k in range(turns):
            rows.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "ü" * 40, "", None])))
    # equal turns with other texts, and rows repeated as a whole
    rows += [(7, 3, "user", "x"), (7, 3, "bot", "x"), (7, 3, "bot", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_plain(spark, seed):
    rows = conversations(seed, 120, 9)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert nodes(df) == plain_trie(rows)
    assert by_sql("op11_conversation_trie", "conversations", TURNS, rows) == counted(prefix_trie.of_blocks(df).drop("digest"))


def test_trie_of_copies_and_of_one_very_long_conversation(spark):
    # a third of all rows are one conversation, another third is copies of one
    rows = [(100, k, "user", f"t{k}") for k in range(900)] + [(1000 + 100 * c, k, "bot", f"s{k % 3}") for c in range(150) for k in range(6)] + [(301, k, None, None) for k in range(7)]
    got = nodes(spark.createDataFrame(rows, TURNS))
    assert got == plain_trie(rows)
    assert sum(got.values()) == len(got)


def test_trie_of_odd_tables(spark):
    assert nodes(spark.createDataFrame([], TURNS)) == collections.Counter()
    assert nodes(spark.createDataFrame([(None, 1, "a", "b")], TURNS)) == collections.Counter()
    long = "w" * 2_000_000
    rows = [(5, None, None, None), (5, None, "x", long), (5, 1, "x", long), (5, 1, "x", long), (0, 1, long, None), (104, 0, "a", "b"), (None, 0, "a", "b")]
    assert nodes(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    clashing = spark.createDataFrame([(1, 1, "a", "b", 5, 6, "q")], TURNS + ", depth int, i int, digest string")
    assert nodes(clashing) == plain_trie([(1, 1, "a", "b")])


def test_many_ends_are_hashed_as_a_stream(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows = [(100 * c, 0, "u", "same") for c in range(1, 400)]
    assert nodes(spark.createDataFrame(rows, TURNS).repartition(7)) == plain_trie(rows)


def test_looked_up_keeps_every_row_of_a_hot_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    out = common.looked_up(many, spark.createDataFrame([(1, "one"), (4, "four")], "k long, said string"), ["k"])
    assert out.count() == 3000 and out.filter("said = 'one'").count() == 1001 and out.filter("said = 'four'").count() == 1


# ---- manifests


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            out.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            i //= 8
        return out

    groups = collections.defaultdict(list)
    for doc, source, lang, n, text in rows:
        leaf = h("".join(map(field, (doc, source, lang, n, text))))
        forged = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        tried = h("".join(map(field, (doc, source, lang, n, low(text))))) if forged else leaf
        groups[lang].append(((doc is not None, doc or 0), leaf, tried, doc))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, leaf, *_ in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = collections.Counter()
    for k, g in enumerate(order):
        for i, (_, leaf, tried, doc) in enumerate(sorted(groups[g])):
            steps = path(trees[g], i) + path(top, k)
            node = tried
            for place, others in steps:
                node = h("".join([*others[:place], node, *others[place:]]))
            root = top[-1][0]
            out[doc, node, leaf, h("".join(x for _, others in steps for x in others)), root, trees[g][-1][0], node == root] += 1
    return out


def manifest(df):
    return counted(merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0))


def documents(seed, sizes):
    rng = random.Random(seed)
    rows = [(None, None, None, None, None), (3, "s", "", 1, "Same"), (3, "s", "", 1, "Same"), (3, "S", "", 1, "Tie"), (None, "a", "en", 5, "NO ID")]
    for lang, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice(["web", None]), lang, rng.choice([7, None]), rng.choice(["", "Abc", "äÖ|x", "lower", None])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


def test_manifest_against_plain(spark):
    rows = documents(1, {"en": 700, "de": 64, "fr": 65, "es": 8, None: 9, "é": 1})
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = manifest(df)
    assert got == plain_manifest(rows) == by_sql("op12_merkle_manifest", "documents", DOCS, rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"en": 4097, "de": 4096}, {"a": 20}, {f"l{k}": 1 + k % 3 for k in range(90)}], ids=["blocks", "few", "many groups"])
def test_manifest_of_trees_of_several_blocks(spark, monkeypatch, sizes):
    """Small blocks stand for large tables: several rounds in groups and in the groups' own tree."""
    rows = documents(2, sizes)
    df = spark.createDataFrame(rows, DOCS)
    assert manifest(df) == plain_manifest(rows)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    if len(rows) < 1000:
        assert manifest(df) == plain_manifest(rows)


def test_traversal_keeps_a_run_and_a_stack_for_each_level():
    for n in (1, 2, 8, 9, 63, 64, 65, 511, 512, 513, 1000, 4096):
        leaves = [hashlib.sha256(bytes([k % 256, k // 256])).hexdigest().encode() for k in range(n)]
        height = sum(n > 8**k for k in range(4))
        root = merkle.block_root(leaves, height)
        for i, path in enumerate(merkle.traversal(leaves, height)):
            assert sum(len(run) for _, run in path) <= 8 * height
            assert merkle.fold(leaves[i], [(k, run[:k] + run[k + 1 :]) for k, run in path]) == root


def test_manifest_of_odd_tables(spark):
    assert manifest(spark.createDataFrame([], DOCS)) == collections.Counter()
    for rows in ([(1, None, None, None, None)], [(None,) * 5] * 3, [(9, "x", "en", 2**40, "W" * 3_000_000), (2**62 + 1, "x", "en", 1, "Q")]):
        assert manifest(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)
    clashing = spark.createDataFrame([(1, "s", "en", 2, "T", 3, "x", 5)], DOCS + ", idx int, grp string, n int")
    assert manifest(clashing) == plain_manifest([(1, "s", "en", 2, "T")])


# ---- archives


def pages(n=60, seed=4):
    rng = random.Random(seed)
    long = ["<p>" + rng.choice("aäb") * k + "</p>" for k in (400, 991, 992, 993, 994, 1500, 40_000)]
    rows = [(k, f"http://x.org/{k}", rng.choice(long) if rng.random() < 0.7 else f"page {k} \r\n\r\n WARC/1.1\r\n") for k in range(n)]
    rows += [(n, None, None), (n + 1, "bad\r\nurl ü", ""), (None, "u", long[-1]), (None, None, long[-1]), (5, "again", rows[5][2]), (5, "again", rows[5][2])]
    rng.shuffle(rows)
    return rows


def plain_archive(rows):
    groups = collections.defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = collections.Counter()
    for payload, ids in groups.items():
        raw = payload.encode()
        ids.sort(key=lambda p: (p is not None, p or 0), reverse=True)
        for k, page in enumerate(ids):
            again = k > 0 and len(raw) >= 1000
            out[page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None] += 1
    return out


def found(df):
    return collections.Counter(tuple(r) for r in warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_archives_against_plain(spark):
    rows = pages()
    got = found(spark.createDataFrame(rows, PAGES).repartition(4))
    assert got == plain_archive(rows)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert by_sql("op13_warc", "pages", PAGES, rows) == collections.Counter({tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names)): k for r, k in got.items()})


def test_archives_of_odd_tables(spark):
    assert found(spark.createDataFrame([], PAGES)) == collections.Counter()
    rows = [(1, "u", "x" * 5_000_000), (2, "u", "x" * 5_000_000), (3, None, None)]
    assert found(spark.createDataFrame(rows, PAGES)) == plain_archive(rows)
    assert found(spark.createDataFrame([(1, "u", "h", 4, "f", 5)], PAGES + ", ordinal int, file string, n_bytes int")) == plain_archive([(1, "u", "h")])
    # a third of all rows share a payload
    hot = [(k, "u", "y" * 1200 if k % 3 else f"{k}" * 300) for k in range(900)]
    assert found(spark.createDataFrame(hot, PAGES).repartition(3)) == plain_archive(hot)


def test_every_record_is_a_member_of_its_own_and_the_index_finds_it(spark, tmp_path):
    rows = pages()
    notes = warc.write(spark.createDataFrame(rows, PAGES).repartition(2), f"file://{tmp_path}/raw", most=13)
    sources = [r.file for r in notes.select("file").distinct().collect()]
    assert len(sources) > 4
    archives = warc.normalise(notes.select("file").distinct(), f"file://{tmp_path}/new")
    for file, n, source in ((r.file, r.n_records, r.source) for r in archives.collect()):
        data, raw = (open(f.removeprefix("file://"), "rb").read() for f in (file, source))
        # one stream before, and the same bytes after
        whole = zlib.decompressobj(31)
        assert whole.decompress(raw) == gzip.decompress(data) and not whole.unused_data
        rest, count = data, 0
        while rest:
            one = zlib.decompressobj(31)
            one.decompress(rest)
            rest, count = one.unused_data, count + 1
        assert count == n <= 13
    got = warc.read(warc.members(archives), with_payload=True).collect()
    assert collections.Counter((r.page_id, bytes(r.payload).decode()) for r in got) == collections.Counter((p, h or "") for p, _, h in rows)


def test_archives_of_others_are_normalised(tmp_path, spark):
    record = lambda k, body: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nX-Folded: a\r\n b\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (k, len(body), body)
    parts = [record(1, b"one"), record(2, b""), record(3, b"x" * 3_000_000)]
    forms = {"plain": b"".join(parts), "whole": gzip.compress(b"".join(parts)), "members": b"".join(map(gzip.compress, parts)), "mixed": gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2]), "empty": b""}
    for name, data in forms.items():
        (tmp_path / name).write_bytes(data)
        n = warc.rewrite(f"{tmp_path}/{name}", f"{tmp_path}/{name}.new", {})
        again = (tmp_path / f"{name}.new").read_bytes()
        assert n == (0 if name == "empty" else 3)
        bodies = [block.read(1 << 30) for _, _, block in warc.records(warc.inflated(io.BytesIO(again)))]
        assert bodies == ([] if name == "empty" else [b"one", b"", b"x" * 3_000_000])
    whole = gzip.compress(b"".join(parts))
    for broken in (whole[:-20], gzip.compress(parts[2][:-5000]), gzip.compress(parts[0][:40]), gzip.compress(b"no record")):
        (tmp_path / "broken").write_bytes(broken)
        with pytest.raises((EOFError, ValueError, zlib.error)):
            warc.rewrite(f"{tmp_path}/broken", f"{tmp_path}/broken.new", {})
    with pytest.raises(ValueError, match="archives can't be kept"):
        warc.store("nowhere://x/y")


# ---- mixtures of many sources


def flow_cost(flows, sizes):
    return sum(min(max(f - s * k, 0), s) * (k + 1) ** 2 for f, s in zip(flows, sizes, strict=True) for k in range(3))


def successive_paths(sizes, members, quotas, limit=3):
    """One word at a time along the cheapest path, found anew each time by relaxing all edges."""
    end = 1 + len(sizes) + len(quotas)
    room, cost = collections.Counter(), {}
    for p, s in enumerate(sizes):
        for r in range(limit):
            room[0, 1 + p, r] += s
            cost[0, 1 + p, r] = (r + 1) ** 2
        for q in members[p]:
            room[1 + p, 1 + len(sizes) + q, 0] += limit * s
    for q, n in enumerate(quotas):
        room[1 + len(sizes) + q, end, 0] += n
    taken = [0] * len(sizes)
    back = collections.Counter()
    while True:
        best, came = {0: 0}, {}
        for _ in range(end + 1):
            for (a, b, r), n in room.items():
                for u, v, c, free in ((a, b, cost.get((a, b, r), 0), n - back[a, b, r]), (b, a, -cost.get((a, b, r), 0), back[a, b, r])):
                    if free > 0 and u in best and best[u] + c < best.get(v, 1e9):
                        best[v], came[v] = best[u] + c, (u, (a, b, r), 1 if u == a else -1)
        if end not in best:
            return taken
        at = end
        while at:
            at, e, sign = came[at]
            back[e] += sign
            if e[0] == 0:
                taken[e[1] - 1] += sign


@pytest.mark.parametrize("seed", range(6))
def test_flows_are_cheapest(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 4)
    sizes = [rng.randint(0, 4) for _ in range(rng.randint(1, 6))]
    members = [rng.sample(range(m), rng.randint(0 if seed % 2 else 1, min(m, 3))) for _ in sizes]
    quotas = [rng.randint(0, 9) for _ in range(m)]
    got, want = mixing.route(sizes, members, quotas), successive_paths(sizes, members, quotas)
    assert sum(got) == sum(want) and flow_cost(got, sizes) == flow_cost(want, sizes)
    # it can be dealt to the sources
    assert all(0 <= f <= 3 * s and (own or not f) for f, s, own in zip(got, sizes, members, strict=True)) and sum(got) <= sum(quotas)


def test_many_patterns_are_routed_soon():
    rng = random.Random(1)
    began = time.time()
    n = 100_000
    assert sum(mixing.route([rng.randint(1, 9) for _ in range(n)], [[k] for k in range(n)], [5] * n)) > n
    sizes = [rng.randint(1, 10_000) for _ in range(2000)]
    flows = mixing.route(sizes, [rng.sample(range(300), rng.randint(2, 4)) for _ in sizes], [rng.randint(1, 60_000) for _ in range(300)])
    assert sum(flows) > 0 and time.time() - began < 60


@pytest.mark.parametrize("overlapping", [False, True])
def test_sources_as_tables_are_those_of_the_driver(spark, monkeypatch, overlapping):
    rng = random.Random(3)
    names = [f"s{k}" for k in range(12)] + [None, "é", ""]
    rows = [(rng.choice([k, k, None, 5]), " ".join("w" for _ in range(rng.choice([0, 1, 3, 9]))), rng.choice(names) if rng.random() < 0.6 else "s1") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sources = F.array_distinct(F.array(F.col("source"), F.when(F.col("source").isin("s1", "s2", "é"), F.lit("s3")).otherwise(F.col("source")))) if overlapping else None
    told = lambda: sorted((tuple(r[c] for c in ("doc_id", "text", "source", "size", "source_size", "taken", "copies", "target")) for r in mixing.mix(df, sources, buckets=16).collect()), key=repr)
    few = told()
    monkeypatch.setattr(mixing, "FEW", 0)
    many = told()
    assert len(many) == len(few) == 900 and [r[:5] for r in many] == [r[:5] for r in few]
    assert all(abs(a[-1] - b[-1]) < 1e-6 for a, b in zip(many, few, strict=True)) and [r[5:7] for r in many] == [r[5:7] for r in few]
    monkeypatch.setattr(mixing, "PATTERNS", 1)
    if overlapping:
        with pytest.raises(ValueError, match="share sources"):
            told()
    assert mixing.mix(df.limit(0)).count() == 0
