"""The registered queries on small tables, and their edge cases."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from veinstone.llm import chat, decontamination, embedding_dedup, near_dedup, packing, pii, quality, registry, shingles, token_counts, toxicity, url_filters
from veinstone.llm.tokenizing import piece_encoder

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, extra string"
EDGE = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "x"), (2**62 + 1, "big id here", "x"), (3, "one", "x"), (4, "one", "y"), (4, "one", "y"), (5, "word " * 20_000, None)]


def docs_of(spark, rows=EDGE, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def unions(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_url_filters_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = con.sql(registry.ORACLES["op1_url_filters"])
    df = url_filters.op1_url_filters(spark, SMALL)
    assert sorted(map(repr, df.select(*want.columns).collect())) == sorted(repr(T.Row(**dict(zip(want.columns, r)))) for r in want.fetchall())


def test_url_filters_by_hand(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org/en/2", "http://b.com/de/x", "b.com/de/x", None, "http://x.org", "http://x.org#a/b", "http://forg/a", "http://y.com/fr/a/b/c/d/e"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judge(pages).collect()}
    assert len(got) == len(urls)
    assert [got[i]["rule"] for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", None, None, None, None, None, "com/fr/"]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/es/1") and (got[5]["host"], got[5]["path"]) == ("", "") == (got[4]["host"], got[4]["path"])
    assert got[7]["path"] == "" and got[0]["verdict"] == "block" and got[2]["verdict"] == "allow" and got[9]["template"] == "/fr/a/b/c/d/e"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_tree_splits_at_any_depth_and_merges_similar_branches(spark):
    # below /a/b/c the fourth segment decides; numbers below are variable, and so are the cities of /shop, which nothing tells apart
    urls = [f"http://h.net/a/b/c/{kind}/{i}" for kind in ("good", "bad") for i in range(60)]
    urls += [f"http://h.net/shop/{city}/{i % 5}" for city in ("rome", "bonn", "oslo") for i in range(40)]
    long = "http://h.net/" + "/".join(f"s{k}" for k in range(60)) + "/" + "x" * 5000
    urls += [long, long, None]
    rules = [("block", "h.net/a/b/c/bad/1"), ("allow", "h.net/a/b/c/good/1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    assert (got[5]["template"], got[5]["verdict"]) == ("/a/b/c/good/*", "allow") and (got[65]["template"], got[65]["verdict"], got[65]["rule"]) == ("/a/b/c/bad/*", "block", None)
    assert got[130]["template"] == "/shop/*/*" and got[len(urls) - 2]["template"].startswith("/s0/s1/") and got[len(urls) - 1]["template"] == ""
    con = duckdb.connect()
    frame = pages.where("page_id < 240").toPandas()  # noqa: F841  read by its name below
    con.sql("CREATE TABLE pages AS SELECT * FROM frame")
    want = con.sql(url_filters.oracle(rules))
    some = url_filters.judge(pages.where("page_id < 240"), rules).select(*want.columns)
    assert sorted(map(tuple, some.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_token_counts(spark):
    p = piece_encoder(public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs_of(spark), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len((t or "").encode()), p.count(t or ""), p.count(t or "") > 4096) for _, t, _ in EDGE)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    df = packing.pack(docs_of(spark), WORDS).fillna(-1, "doc_id")
    got = df.toPandas()
    whole = {}
    for doc_id, text, _ in EDGE:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            whole.setdefault((doc_id if doc_id is not None else -1, piece, at, len(part), zlib.crc32(part.tobytes())), []).append(1)
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == sorted(k for k, n in whole.items() for _ in n)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert packing.pack(docs_of(spark).limit(0), WORDS).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((i * 3, rng.choice([" ", "\n"]).join(w), "x"))
    rows += [(1000 + i, t, "x") for i, t in enumerate(["", None, "Solo", "solo", "two words"])]
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = unions(len(rows), links)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, _, _) in enumerate(rows):
        assert (got[doc_id]["n_shingles"], got[doc_id]["component_id"], got[doc_id]["kept"]) == (len(sets[k]), rows[root[k]][0], root[k] == k)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(120)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w), "x"))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t, _ in rows]
    root = unions(120, [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(120)] == root


def test_near_duplicates_edges(spark):
    got = near_dedup.near_duplicates(docs_of(spark)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["component_id"], by[1]["kept"], by[1]["n_shingles"]) == (1, True, 0) and by[4]["component_id"] == 3 and not by[4]["kept"] and by[5]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"] is False
    assert near_dedup.near_duplicates(docs_of(spark).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["nid"]: r["label"] for r in near_dedup.components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


@pytest.mark.parametrize("hot", [64, 6, 1])
def test_embeddings_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "HOT", hot)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + 0.1 * rng.normal(size=(30, 16)), x[:5], 2 * x[5:8]])
    rows = [(i * 2, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(900, None, "x"), (901, [], "x"), (902, [0.0] * 16, "x"), (903, [1.0, None] + [0.0] * 14, "x"), (904, [float("nan")] * 16, "x"), (905, [float("inf")] + [1.0] * 15, "x"), (906, [1e300] + [0.0] * 15, "x"), (907, [1.0] + [0.0] * 15, "x"), (908, [1.0], "x")]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = n @ n.T >= 0.9
    np.fill_diagonal(near, False)
    root = unions(len(x), np.argwhere(near).tolist())
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, nid string")).collect()}
    assert [got[i * 2]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i * 2]["component_id"] for i in range(len(x))] == [2 * k for k in root]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(900, 909)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 904), (0, 905), (1, 906), (1, 906), (0, 908)]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of night"
    bench = spark.createDataFrame([(7, passage), (8, None), (9, "tiny"), (10, "another long passage that nobody would ever write in a plain text by chance")], "item_id long, text string")
    rows = EDGE + [(20, "x " * 50 + passage.upper() + " y", "z"), (21, "clean text of no interest at all to anyone", "z")]
    for size in (2_000_000, 600):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        got = {r["doc_id"]: r for r in decontamination.find(docs_of(spark, rows), bench).collect()}
        assert [k for k, r in got.items() if r["contaminated"]] == [20] and got[20]["item_ids"] == "7" and got[20]["n_items"] == 1 and got[20]["spans"] == f"100:{100 + len(passage)}"
        assert decontamination.keep_clean(docs_of(spark, rows), bench).count() == len(rows) - 1
    assert not decontamination.find(docs_of(spark), bench.limit(0)).where("contaminated").count()


def test_pii(spark):
    rows = EDGE + [(30, "mail a.b@c.de or +1 (988) 555-2485; 10.0.0.1", "z")]
    got = {r["doc_id"]: r for r in pii.find(docs_of(spark, rows)).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert (got[30]["n_email"], got[30]["n_ip"], got[30]["n_card"], got[30]["n_phone"]) == (1, 1, 0, 1) and got[30]["spans"] == "email:5:13,ip:36:44,phone:17:34"
    assert got[1]["spans"] == "" == got[2]["spans"] and got[1]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs_of(spark, rows)).collect()}
    assert out[30] == "mail <EMAIL> or <PHONE>; <IP>" and out[1] is None and out[5] == EDGE[-1][1]


@pytest.mark.parametrize("op", ["op5_toxicity", "op7_quality"])
def test_classifiers_on_held_out_rows(spark, op):
    path = "/root/testdata/sf0.01"
    got = registry.QUERIES[op](spark, path).toPandas()
    labels = spark.read.parquet(path + "/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(path + "/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    y = m["toxic" if op == "op5_toxicity" else "quality"]
    rank = m.score.rank()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9, auc


def test_classifiers_on_edge_cases(spark):
    docs = docs_of(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (2, None, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert toxicity.score(docs, toxicity.train(docs, labels)).count() == len(EDGE)
        vectors = quality.word_vectors(docs)
        assert quality.score(docs, vectors, quality.train(docs, labels, vectors)).count() == len(EDGE)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, odd)).count() == 0
    assert not quality.word_vectors(empty).any()


def test_chat_links(spark):
    rows = [(1, 0, "user", "How do I bake bread at home today?"), (1, 1, "assistant", "Use flour.\n\nThen wait for an hour."), (1, 2, "user", "> Then wait for an hour.\nWhy so long?"), (2, 0, "user", ">> How do I bake bread at home today?\n> nobody said these words\nmy question"), (2, 1, None, None), (None, 1, "user", "> a"), (3, 40_000, "user", "late"), (3, 5, "user", "early")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[1, 2]["reply_turn"], got[1, 2]["linked_by"], got[1, 2]["text"]) == (1, "quote", "Why so long?")
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"], got[2, 0]["thread_id"], got[2, 0]["n_quoted"], got[2, 0]["n_linked"]) == (1, 0, 1, 2, 1)
    assert got[2, 1]["thread_id"] == 1 and got[2, 1]["reply_turn"] == 0 and got[3, 40_000]["reply_turn"] == 5 and got[1, 0]["linked_by"] == "none"
    for r in got.values():  # a reply comes after its original
        if r["reply_conv"] is not None:
            assert (r["reply_conv"], r["reply_turn"]) < (r["conv_id"], r["turn"])
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        kept = near_dedup.materialize(out, "test-" + name)
        sizes.append(kept.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4] > sizes[0] // 2
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed.doc_id) == ids
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"


@pytest.mark.parametrize("name", ["op9_near_dedup", "op10_embedding_dedup"])
def test_similarity_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_ids_keep_their_digits_beside_nulls(spark):
    got = token_counts.count_tokens(docs_of(spark), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.where(f"doc_id = {2**62 + 1}").count() == 1 and near_dedup.near_duplicates(docs_of(spark)).where(f"component_id = {2**62 + 1}").count() == 1


def test_near_duplicates_with_repeated_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, long + " a", "x"), (None, long + " b", "x"), (None, other, "x"), (7, long, "x"), (7, other + " c", "x"), (7, other + " d", "x"), (9, long + " e", "x")]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == sorted([(0, 7, False)] * 3 + [(7, 7, True)] * 3 + [(9, 7, False)])


def test_near_dedup_stage_keeps_one_of_each_group(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(i, t, "en", "s", 1) for i, t in [(3, long), (3, long), (5, long + " x"), (9, "other words here"), (None, "no id"), (10, None), (11, "")]]
    docs = spark.createDataFrame(rows, schema)
    for most in (2_000_000, 0):
        monkeypatch.setattr(near_dedup, "MOST_SENT", most)
        got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "no id"), (3, long), (9, "other words here"), (10, ""), (11, "")]


def test_near_dedup_stage_keeps_one_row_of_an_id_with_near_copies(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long + " a"), (3, long + " b"), (None, long + " c"), (None, "alone here"), (None, "alone here"), (None, ""), (None, ""), (4, None), (4, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone_hash string"), SMALL)
    assert got.columns == ["doc_id", "text", "gone_hash"]
    kept = sorted(map(repr, (tuple(r)[:2] for r in got.collect())))
    assert sum("w1 " in k for k in kept) == 1 and sum("(3, " in k for k in kept) == 1
    assert sum("alone here" in k for k in kept) == 1 and kept.count("(None, '')") == 2 and kept.count("(4, None)") == 2


def test_stages_on_empty_and_odd_tables(spark):
    odd = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "no id but words", None), (3, "word " * 40_000, "z"), (5, "plain text of a few words", "z"), (5, "plain text of a few words", "z")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, label string")
    for frame, rows in ((docs, 6), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == docs.columns
            frame = near_dedup.materialize(out, "odd")
        assert frame.count() == rows
        assert corpus_pipeline.pack_sequences(spark, frame, SMALL).select("doc_id").distinct().count() == min(rows, 5)


def test_near_dedup_stage_drops_copies_between_80_and_85_percent(spark):
    words = [f"w{k}" for k in range(60)]
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # 51 of 61 shingles (0.836) and, by two changes, 46 of 66 (0.697) are shared with the first
    rows = [(1, " ".join(words), "en", "s", 1), (2, changed(30), "en", "s", 1), (3, changed(10, 50), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == [1, 3]
    assert {r["doc_id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()} == {1, 2, 3}


def test_chat_links_parts_of_messages(spark):
    first = "One paragraph about bread and flour.\n\nTwo lines of text stand\nin this middle part. Then comes another whole sentence.\n\nThe third paragraph ends it all."
    quotes = ["> One paragraph about bread and flour.\n>\n> Two lines of text stand\n> in this middle part. Then comes another whole sentence.", "> Two lines of text stand", "> Then comes another whole sentence.", "> nobody ever wrote these words"]
    rows = [(1, 0, "user", first), (1, 1, "assistant", "something else")] + [(1, 2 + k, "user", q + "\nreply") for k, q in enumerate(quotes)]
    got = {r["turn"]: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[t]["reply_turn"], got[t]["linked_by"], got[t]["n_quoted"], got[t]["n_linked"]) for t in (2, 3, 4, 5)] == [(0, "quote", 1, 1)] * 3 + [(4, "previous", 1, 0)]


def _chat_by_brute_force(rows):
    """Reply and thread of each message, one by one."""
    parsed = [chat.parse(t) for *_, t in rows]
    held = {}
    for (c, t, *_), (own, _) in zip(rows, parsed):
        for h in chat.own_passages(own):
            held.setdefault(h, []).append((c, t))
    out = []
    for (c, t, *_), (own, quoted) in zip(rows, parsed):
        best, linked = None, set()
        for k, (level, q) in enumerate(quoted):
            for h, words, part in chat.units(q):
                places = held.get(h, [])
                mine = min((x for x in places if x[0] == c), default=None)
                others = len({x[0] for x in places} - {c})
                if mine and mine[1] < t and (not part or words >= chat.LEAST_WORDS or others == 0):
                    found = (level, part, 0, mine)
                elif places and min(places) < (c, t) and min(places)[0] != c and (words >= chat.LEAST_WORDS or others == 1):
                    found = (level, part, 1, min(places))
                else:
                    continue
                linked.add(k)
                best = found if best is None else min(best, found)
        before = max((x[1] for x in rows if x[0] == c and x[1] < t), default=None)
        reply = best[3] if best else (c, before) if before is not None else None
        out.append((c, t, own, reply, "quote" if best else "previous" if reply else "none", len(quoted), len(linked)))
    ids = sorted({r[0] for r in rows})
    root = unions(len(ids), [(ids.index(o[0]), ids.index(o[3][0])) for o in out if o[3]])
    return [(*o, ids[root[ids.index(o[0])]]) for o in out]


def test_chat_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    sentences = ["Thanks a lot.", "Yes", "How do I bake bread at home?", "Use flour and water for it.", "Then wait for one hour.", "My oven is far too hot today.", "Nobody knows.", "Buy a scale for the flour."]
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 6)):
            own = "\n".join(rng.choice(sentences) + rng.choice(["", f" {rng.choice(sentences)}", "\n"]) for _ in range(rng.randint(0, 2)))
            lines = []
            for _ in range(rng.choice([0, 0, 1, 2])):
                lines += [rng.choice(["> ", ">> ", "> > "]) + x for x in rng.choice(rows)[3].split("\n")] if rows and rng.random() < 0.8 else ["> words that nobody wrote"]
            rows.append((c, t, "user", "\n".join([*lines, own]) if lines else own))
    rows.append((30, 0, "user", rows[0][3]))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(_chat_by_brute_force(rows), key=repr)
    got = chat.link(frame).collect()
    assert sorted(((r["conv_id"], r["turn"], r["text"], (r["reply_conv"], r["reply_turn"]) if r["reply_turn"] is not None else None, r["linked_by"], r["n_quoted"], r["n_linked"], r["thread_id"]) for r in got), key=repr) == want
    assert sum(r["linked_by"] == "quote" for r in got) > 10
    place = {(r["conv_id"], r["turn"]): (r["thread_id"], r["position"]) for r in got}
    for r in got:  # a reply stands after its original, in its thread
        if r["reply_turn"] is not None:
            thread, position = place[r["reply_conv"], r["reply_turn"]]
            assert thread == r["thread_id"] and position < r["position"]
    for thread in {r["thread_id"] for r in got}:
        assert sorted(r["position"] for r in got if r["thread_id"] == thread) == list(range(sum(r["thread_id"] == thread for r in got)))
    texts = {(r["thread_id"], r["part"]): r for r in chat.conversations(chat.link(frame), 2).collect()}
    assert sum(r["n_messages"] for r in texts.values()) == len(rows) and max(r["n_messages"] for r in texts.values()) <= 2


def test_chat_edge_cases(spark):
    rows = [(1, 0, None, "word " * 30_000), (1, 1, "a", "> " + "word " * 30_000 + "\nyes"), (1, 1, "a", "> " + "word " * 30_000 + "\nyes"), (None, None, None, None), (None, 3, "x", ""), (5, None, "x", "> yes")]
    got = chat.link(spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, thread_id string")).collect()
    assert len(got) == len(rows)
    assert [(r["reply_turn"], r["linked_by"]) for r in got if r["conv_id"] == 1 and r["turn"] == 1] == [(0, "quote")] * 2
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2] and sorted(r["position"] for r in got if r["conv_id"] is None) == [0, 1]


def test_stages_leave_nothing_in_python_workers(spark):
    """The pipeline's stages share their workers: memory that one keeps is missing for the next."""
    words = [f"w{i}x{j}" for i in range(40) for j in range(50)]
    docs = docs_of(spark, [(i, " ".join(words[i * 50 : i * 50 + 50]), "x") for i in range(40)]).repartition(8)

    def kept(df, module, name):
        def look(batches):
            import importlib

            import pyarrow as pa

            held = getattr(importlib.import_module(module), name)
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(held)] * b.num_rows, pa.int64())], names=["n"])

        return max(r["n"] for r in df.mapInArrow(look, "n long").collect())

    model = toxicity.FactorizationMachine(-1.0, np.zeros((toxicity.SPACE, toxicity.FACTORS + 1), np.float32))
    assert toxicity.keep_clean(docs, model).count() == 40
    assert kept(docs, "veinstone.llm.toxicity", "_memo") == 0
    near_dedup.signatures(docs).collect()
    assert kept(docs, "veinstone.llm.shingles", "_powers") == 0
    benchmark = spark.createDataFrame([(7, " ".join(words[100:130]))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.keep_clean(docs, benchmark).select("doc_id").collect()) == [i for i in range(40) if i != 2]
    for _ in range(2):  # the next operator's tasks, in the same workers
        assert pii.redacted(docs).count() == 40
    assert kept(docs, "veinstone.llm.decontamination", "_cache") == 0


def test_tables_of_powers_share_the_longest():
    shingles._powers.clear()
    for n in (5_000, 1 << 20, 100_000):
        power, inverse = shingles._power_table(n)
        assert len(power) >= n and (power[:5_000] * inverse[:5_000] == 1).all() and len(shingles._powers) == 1
    texts = ["a b c d e f", "one two three four five six seven " * 50]
    after = shingles.shingle_sets(texts)
    shingles._powers.clear()
    assert all((x == y).all() for x, y in zip(after, shingles.shingle_sets(texts), strict=True))
