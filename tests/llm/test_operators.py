import base64
import hashlib
import os
import pathlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import common, exact_dedup, licenses, mixing, ngram_join, packing, pii, quality_rules, toxicity, url_templates, warc_archive

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, level int, name string"
BASE = " ".join(f"word{i}" for i in range(80))


def docs(spark, texts, sources=None):
    """Documents with nulls, empty and repeated rows among `texts`, and columns whose names clash with inner ones."""
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or ""), 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   ", "\n", "a", BASE, BASE, BASE.replace(" ", "  \n"), BASE + " more", "é" * 9000 + " x", BASE.upper(), "1 " * 30]


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def test_exact_dedup_odd_rows(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, ODD), block=64).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (same[0], len(same), i == same[0])
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs(spark, ODD).unionByName(docs(spark, ODD))).count() == len(set(norm))


def test_exact_dedup_unifies_hot_blocks(spark):
    texts = ["same " * 40] * 150 + ["same " * 40 + str(i) for i in range(5)]
    got = exact_dedup.exact_dedup(docs(spark, texts), block=32).collect()
    assert sum(r["kept"] for r in got) == 6 and max(r["group_size"] for r in got) == 150


@needs_tables
@pytest.mark.parametrize("f,sql", [(exact_dedup.op9_exact_dedup, exact_dedup.OP9_SQL), (quality_rules.op4_line_frequency, quality_rules.OP4_SQL)])
def test_equals_sql(spark, f, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel, df = con.sql(sql), f(spark, SF)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_quality_removes_common_lines(spark):
    line = "this line is on every page of the site and says nothing"
    texts = [f"{BASE.replace('word', f'w{i}x')}\n{line}" for i in range(25)] + [(line + " again\n") * 3, None, ""]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d).collect()}
    assert got[0]["removed_share"] == 0 and got[1]["removed_share"] > 0 and got[1]["kept"]
    assert got[26]["base_failed"] and got[26]["n_words"] == 0 and got[25]["n_repeat_words"] == 39 and got[25]["n_dup_lines"] == 2
    kept = {r["doc_id"]: r["text"] for r in quality_rules.clean(d).collect()}
    assert set(kept) == set(range(25)) and line in kept[0] and line not in kept[1]
    assert quality_rules.quality_rules(d.limit(0)).count() == 0


def test_near_duplicates_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    r = np.random.default_rng(3)
    texts = list(ODD)
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(9):
            w = list(words)
            for p in r.integers(0, 60, r.integers(0, 5)):
                w[p] = f"e{r.integers(1 << 30)}"
            texts.append(" ".join(w))
    got = {x["doc_id"]: x for x in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(texts)
    assert all(got[i]["n_shingles"] == len(shingle_set(t)) for i, t in enumerate(texts))
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_bitmaps_never_part_a_pair_that_links():
    r = np.random.default_rng(5)
    for size in (1, 3, 40, 900, 6000):
        for changed in (0, 1, size // 8, size // 4, size):
            x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            y = np.unique(np.r_[x[changed:], r.integers(0, 1 << 63, changed, dtype=np.uint64) * np.uint64(2)])
            apart = sum(int(v).bit_count() for v in (ngram_join._bitmap(x) ^ ngram_join._bitmap(y)).view(np.uint64))
            assert apart <= len(np.setxor1d(x, y))


def test_near_duplicates_of_ids_with_texts_of_one_size(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " x"), (3, texts[1] + " x"), (4, texts[2])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("block", [400, 1 << 21])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, block):
    """Copies around the threshold: one group of several components, compared in blocks."""
    monkeypatch.setattr(ngram_join, "GROUP", 50)
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    r = np.random.default_rng(11)
    texts = []
    for g in range(2):
        words = [f"g{g}w{i}" for i in range(100)]
        for _ in range(100):
            w = list(words)
            for p in r.integers(0, 100, r.integers(1, 9)):
                w[p] = f"e{r.integers(1 << 30)}"
            texts.append(" ".join(w))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 20


def test_wide_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    rows = [(i, f"t{i}") for i in range(3000)] + [(None, "n"), (7, "again"), (-9, "x")]
    left = spark.createDataFrame(rows, "k long, text string")
    for keys in ([*range(0, 3000, 40), 5_000_000], [*range(0, 3000, 40), None], [None] + [-i for i in range(1, 30)]):
        right = common.pin(spark.createDataFrame([(k,) for k in keys], "k long"))
        for how, want in (("left_anti", [r for r in rows if r[0] not in keys]), ("left_semi", [r for r in rows if r[0] in keys])):
            got = common.lookup_wide(left, right, "k", how)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        two = common.pin(right.withColumn("v", F.lit(1)).union(right.withColumn("v", F.lit(2))))
        got = common.lookup_wide(left, two, "k", "inner").select("k", "text", "v").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((*r, v)) for r in rows if r[0] in keys for v in (1, 2))


def test_texts_are_not_shuffled_beyond_the_broadcast_bound(spark, monkeypatch, tmp_path):
    """With more copies than may be broadcast, only texts that may have one are dealt out; pins leave no shuffle files."""
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{v}" for v in r.integers(0, 1 << 40, 60)) for _ in range(400)]
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[:20]] + texts[:20]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d"))
    want = {x["doc_id"] for x in ngram_join.one_of_each(rows).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common.lookup_join, "__defaults__", (None, "left", 10))
    kept = ngram_join.one_of_each(rows)
    assert {x["doc_id"] for x in kept.collect()} == want == set(range(400))
    # Texts that are dealt out come through the bits of the keys.
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan and "LeftSemi" in plan


def test_pins_leave_no_shuffle_files(spark):
    def files():
        dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {str(f) for d in dirs for f in pathlib.Path(d.toString()).glob("*/shuffle_*.data")}

    before = files()
    pinned = common.pin(spark.range(20_000).repartition(3, "id"))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and pinned.count() == 20_000


def test_components_of_many_edges(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90)], "x long, y long")
    want = {i: 0 for i in range(1, 31)} | {100: 90}
    for bound in (10, 1000):
        monkeypatch.setattr(ngram_join, "ONE_TASK", bound)
        assert {r["node"]: r["label"] for r in ngram_join.components(links).collect()} == want


def test_mix_meets_targets_and_repeats(spark):
    texts = [("w " * (1 + i * 7 % 90)) for i in range(400)] + [None, ""]
    sources = [f"s{i % 5}" if i % 9 else None for i in range(402)]
    d = docs(spark, texts, sources)
    a = mixing.mix(d).toPandas()
    assert a.sort_values("doc_id").taken.tolist() == mixing.mix(d.repartition(7)).toPandas().sort_values("doc_id").taken.tolist()
    a["source"] = a.source.fillna("\uffff")  # null is last
    sizes = a.groupby("source")["size"].sum()
    total, weights = sizes.sum(), dict(zip(sorted(sizes.index), [5, 2, 1, 5, 2, 1], strict=True))
    goal = {s: 0.0 for s in sizes.index}
    low, high = 0.0, float(total)
    for _ in range(80):
        mid = (low + high) / 2
        goal = {s: min(2.0 * n, mid * weights[s]) for s, n in sizes.items()}
        low, high = (mid, high) if sum(goal.values()) < 1.5 * total else (low, mid)
    for s, g in a.groupby("source"):
        assert abs(g.target.iloc[0] - goal[s]) < 1e-6 * total and abs(g.taken.sum() - g.target.iloc[0]) <= max(3, 0.02 * g.target.iloc[0])
    assert (a.taken <= 2 * a["size"]).all() and mixing.mix(docs(spark, [])).count() == 0


def test_places_of_sources_take_no_table_of_the_driver(spark, monkeypatch):
    names = [*(f"s{i:03}" for i in range(200)), None, "é"]
    sources = common.pin(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5))
    nothing = common.pin(sources.filter("source_size < 0"))

    def workers(*_, **__):
        raise AssertionError("createDataFrame starts Python workers of another kind")

    monkeypatch.setattr(type(spark), "createDataFrame", workers)
    for parts in (10_000, 100):
        monkeypatch.setattr(sources, "count", lambda n=parts: 202 * 10_000 // n)
        got = {r["source"]: r["place"] for r in mixing._indexed(sources).collect()}
        assert got == {n: i for i, n in enumerate([*sorted(n for n in names if n), None])}
    assert mixing._indexed(nothing).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = [None, "", "It's  Ünïcode <|endoftext|> 日本語, 12.5% e\u0301 ...", *["tokens, of words. " * n for n in (1, 50, 400, 900, 3000)]] * 3
    got = packing.pack(docs(spark, texts).repartition(3), path, window=256, open_windows=4).toPandas()
    t = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    sequences = got.groupby("sequence_id").length.sum()
    assert sequences.sum() >= 0.9 * 256 * (len(sequences) - 1)
    assert packing.pack(docs(spark, []), path).count() == 0


def test_word_ids_equal_the_tokenizers():
    import random

    ids, r = packing.WordIds(packing.tokenizer_path()), random.Random(4)
    odd = ["a", "The", "İ", "i\u0307", "ß", "ſ", "K", "é", "e\u0301", "\u0307", ".", ",", "'s", "'LL", "12", "½", "日本", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", " ", "\n", "\u3000", "\u200b", "<|endoftext|>"]
    for _ in range(20000):
        t = "".join(r.choice(odd) for _ in range(r.randint(1, 8)))
        assert np.frombuffer(ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_need_no_whole_run_of_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    whole, asked = Tokenizer.from_file(packing.tokenizer_path()), []
    got = packing.WordIds(packing.tokenizer_path())
    monkeypatch.setattr(got, "_whole", lambda w, f=got._whole: asked.append(w) or f(w))
    monkeypatch.setattr(packing, "CACHED_WORDS", 300)
    r = np.random.default_rng(12)
    plain = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)] if c not in (ord("'"), 0xD7, 0xF7)]
    odd = [*plain, "'s", "'Re", "<|endoftext|>", "\u0301", "\u0130", "\u03a3", "\xd7", "\xb5", "\xad", "\u0153", "\u4e2d", "\xa0"]
    for letters in (plain, odd):
        for _ in range(400):
            text = " ".join("".join(r.choice(letters, r.integers(1, 9))) for _ in range(8))
            assert np.frombuffer(got(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
        if letters is plain:
            assert all("<|" in w for w in asked)
    assert got("a" * 5000 + "'") == got._whole("a" * 5000 + "'")  # a long word that is not plain takes no long match
    assert asked and len(got.known) <= 400 and len(got.known.old) <= 400


def test_remembered_words_are_bounded_in_bytes():
    ids = packing.WordIds(packing.tokenizer_path())
    for i in range(40):
        word = str(10**6 + i) * 30_000  # 210 KB, and 840 KB of ids
        assert len(ids(word)) == 4 * len(word)
    held = sum(len(w) + len(x) for words in (ids.known, ids.known.old) for w, x in words.items())
    assert held < 36 << 20  # two generations and a word


def test_idle_workers_forget_words(spark):
    import pyarrow as pa

    def remembered(batches):
        from lagweave.llm import packing

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(packing._word_ids)] * b.num_rows})

    packing.pack(docs(spark, ["some words"] * 40).repartition(8), packing.tokenizer_path()).count()
    time.sleep(packing.REST_S + 1.5)
    assert [r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(remembered, "n long").collect()] == [0] * 8


def test_word_ids_keep_separators():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, ids = Tokenizer.from_file(path), packing.WordIds(path)
    for t in ("hello\x1cworld a\x1c b.", "\x1d", "a\x1e b\x1fc", "hello world."):
        assert np.frombuffer(ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_open_windows_place_best_fit():
    w = packing.OpenWindows(10, 2)
    assert w.add(6, "a") == [] and w.add(7, "b") == [] and w.add(3, "c") == [["b", "c"]]
    assert w.add(5, "d") == [] and w.add(8, "e") == [["a"]]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(5, "http://a/\r\n", "same"), (2, "b", "same"), (9, None, None), (7, "c", ""), (1, "d", "é")], "page_id long, url string, html string")
    payloads, records = warc_archive.write_archive(pages)
    got = {r["page_id"]: r for r in warc_archive.read_archive(spark, payloads, records).collect()}
    sha = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in pages.collect()}
    assert {i: r["payload_digest"] for i, r in got.items()} == sha and all(r["verified"] for r in got.values())
    assert {i: r["refers_to"] for i, r in got.items()} == {5: 2, 2: None, 9: 7, 7: None, 1: None} and got[1]["payload_bytes"] == 2
    whole = [bytes(r[0]) for r in warc_archive.original_records(spark, payloads, records).collect()]
    assert len(whole) == 5 and sum(b"\r\n\r\nsame\r\n\r\n" in w for w in whole) == 1
    assert warc_archive.read_archive(spark, *warc_archive.write_archive(pages.limit(0))).count() == 0
    spark.table(payloads).filter("payload <> CAST('same' AS BINARY)").write.mode("overwrite").saveAsTable(payloads + "_damaged")
    damaged = {r["page_id"]: r for r in warc_archive.read_archive(spark, payloads + "_damaged", records).collect()}
    assert len(damaged) == 5 and {i for i, r in damaged.items() if not r["verified"]} == {2, 5}
    assert {i: r["payload_digest"] for i, r in damaged.items()} == sha
    for t in (payloads, payloads + "_damaged"):
        spark.sql(f"DROP TABLE {t}")


def test_deep_paths_keep_supported_segments(spark):
    deep = "/".join(f"s{i}" for i in range(9))
    rows = [("h", f"/{deep}/{i % 2}a") for i in range(40)] + [("h", "/x/y/z/u/v/w/q/r/s/t")]
    got = url_templates.templates(spark.createDataFrame(rows, "host string, path string")).groupBy("template").count().collect()
    assert {r["template"]: r["count"] for r in got} == {f"/{deep}/0a": 20, f"/{deep}/1a": 20, "/*/*/*/*/*/*/**": 1}


def test_url_rules_and_templates(spark):
    urls = [None, "no scheme", "HTTP://A.Org/x?y", "http://example.org/es/1", "http://b.example.org/en/15#z", "x://c.com/fr/a", "x://c.com/de/", "x://org", "x://n.net/a://b"]
    urls += [f"http://h.com/{'de' if i % 2 else 'it'}/{i}" for i in range(60)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_templates.filter_urls(d).collect()}
    assert [got[i]["rule"] for i in range(9)] == [None, None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None]
    assert (got[2]["host"], got[2]["path"], got[8]["host"], got[8]["path"]) == ("a.org", "/x", "n.net", "/a://b")
    assert got[9]["template"] == "/it/*" and got[10]["template"] == "/de/*" and got[10]["purity"] > 0.8
    assert url_templates.filter_urls(d.limit(0)).count() == 0


def test_url_branches_of_a_large_host(spark):
    urls = [f"http://big.net/{'de' if i % 30 == 0 else f'b{i % 30}'}/{i}" for i in range(600)]  # 3% of the urls are below /de/
    urls += [f"http://h{i % 5}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(400)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_templates.filter_urls(d).collect()}
    assert {(got[i]["template"], got[i]["verdict"]) for i in range(0, 600, 30)} == {("/de/*", "block")}
    rows = [("h", "/a/p/*", 1)] * 10 + [("h", "/a/q/*", 0)] * 10 + [("h", "/a/p/x", 0), ("h", "/a/q/y", 1), ("h", "/b/c", None)]
    judged = {r["template"]: r for r in url_templates.judged_templates(spark.createDataFrame(rows, "host string, template string, label int")).collect()}
    assert judged["/a/p/*"]["purity"] > 0.8 > 0.5 > judged["/a/q/y"]["purity"] and judged["/a/p/x"]["purity"] > 0.5
    assert len(judged) == 5 and judged["/a/q/*"]["purity"] < 0.2


def test_base_spans_brute_force():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = np.random.default_rng(0)
    for _ in range(3000):
        t = "".join(r.choice(list("ab1234567890@.+-() 4"), 40))
        want = [(0, *m.span()) for m in email.finditer(t)] + [(1, *m.span()) for m in ip.finditer(t) if all(int(x) < 256 for x in m[0].split("."))]
        for kind, p, least, most in ((2, card, 13, 19), (3, phone, 9, 15)):
            for m in p.finditer(t):
                digits = re.sub("[^0-9]", "", m[0])
                if least <= len(digits) <= most and (kind == 3 or pii._luhn(digits)):
                    want.append((kind, *m.span()))
        assert pii.base_spans(t)[0] == want


def test_tagger_gradient_and_learning(spark):
    g, r = pii.Tagger(), np.random.default_rng(1)
    x, y = r.integers(0, pii.N_CLASSES, (2, 8)), r.integers(0, pii.TAGS, (2, 8))
    _, grad = g.step(x, y)
    for k in ("fu", "w", "a"):
        g.p[k][0, 1] += 1e-5
        up = g.step(x, y)[0]
        g.p[k][0, 1] -= 2e-5
        assert abs((up - g.step(x, y)[0]) / 2e-5 - grad[k][0, 1]) < 1e-5
        g.p[k][0, 1] += 1e-5
    texts = [f"call me at +1 (976) 555-{i:04d} or write to bob.{i}@mail{i}.example.com from {i}.2.3.4 " for i in range(200)] + [None, "", "x" * 5000 + " a.b@c.de"]
    got = {x["doc_id"]: x for x in pii.find_personal_data(docs(spark, texts)).collect()}
    assert got[0]["n_email"] == got[0]["n_ip"] == got[0]["n_phone"] == 1 and got[200]["spans"] == "" and got[202]["spans"] == "email:5001:5009"
    assert pii.reconciled([(0, 0, 60, 64), (32, 0, 60, 70)], 500) == [(0, 60, 70)]


def test_tagger_adds_spans_in_failing_base_matches(spark):
    r, rows = np.random.default_rng(3), []

    def card():
        d = "".join(map(str, r.integers(0, 10, 15)))
        return next(c for i in range(10) if pii._luhn(c := f"{d}{i}"))

    for i in range(150):
        tags = np.zeros(pii.WINDOW, np.int8)
        a, b, n = card(), card(), int(r.integers(3, 9))
        phone, word = f"(0{r.integers(10, 99)}) 555-{r.integers(1000, 9999)}", "abcdefgh"[:n]
        text, at = (f"{word} {a} {b} {word}", len(a) * 2 + 1) if i % 2 else (f"{word} {phone} {word}", len(phone))
        tags[n + 1 : n + 1 + at] = 6 if i % 2 else 8
        tags[n + 1] -= 1
        rows.append((text, tags))
    x = np.concatenate([pii._windows(pii.classes(t), np.array([0])) for t, _ in rows])
    g = pii.Tagger()
    g.fit(x, np.stack([y for _, y in rows]), steps=300)
    c = "4465758382889437"
    texts = [f"abcd {c} {c} abcd", "abcd (076) 555-0137 abcd", "abcd 1234567 abcd"]
    got = [x["spans"] for x in pii.find_personal_data(docs(spark, texts), tagger=g).orderBy("doc_id").collect()]
    assert got == ["card:5:21,card:22:38", "phone:5:19", ""]


def test_windows_of_the_tagger_join(spark):
    for start, end in ((64, 96), (10, 110), (33, 95), (0, 200)):
        tags = np.zeros(256, np.int8)
        tags[start:end] = 2
        tags[start] = 1
        starts = np.arange(0, 192 + 1, pii.STRIDE)
        assert pii.joined(starts, tags[starts[:, None] + np.arange(pii.WINDOW)]) == [(0, start, end)]
    starts = pii.window_starts(pii.classes("w " * 100 + "é" * 100 + "@b.cd " + "w " * 100))
    assert starts.min() <= 200 and starts.max() + pii.WINDOW >= 306 and (np.diff(starts) == pii.STRIDE).all()


def test_block_max_index_is_exact():
    r = np.random.default_rng(2)
    vectors = []
    for _ in range(400):
        t = np.sort(r.choice(60, 6, replace=False))
        w = r.random(6)
        vectors.append((t, w / np.linalg.norm(w)))
    index, dense = toxicity.BlockMaxIndex(vectors, 60, block=16), np.zeros((400, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:40]:
        ids, sims = index.search(t, w, 10)
        full = np.zeros(60)
        full[t] = w
        assert np.allclose(sims, np.sort(dense @ full)[::-1][:10]) and len(set(ids)) == 10


def test_toxicity_learns_and_holds_out(spark):
    bad = ["vilewordish", "nastythingy"]
    texts = [f"{BASE} {'and ' + bad[i % 2] if i % 3 == 0 else 'fine'} t{i}" for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, texts), labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(302))
    held = [i for i in range(300) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95 and got[300]["predicted"] == 0
    assert toxicity.toxicity(docs(spark, texts), labels.limit(0)).count() == 302


def dense_toxicity(texts, toxic):
    """Scores by plain loops: every similarity is computed, nothing is indexed. toxic: label by id."""
    learn = [i for i in toxic if zlib.crc32(str(i).encode()) % 5]
    bags = []
    for t in texts:
        bag = {}
        for w in toxicity._words(t):
            for term in set(toxicity._terms(w)):
                bag[term] = bag.get(term, 0) + 1
        bags.append(bag)
    n1 = sum(toxic[i] for i in learn)
    rate, least = (n1 + 0.5) / (len(learn) + 1), min(toxicity.LEAST, max(2, round(n1 / 20)))
    chi = {}
    for term in {t for i in learn for t in bags[i]}:
        have = [i for i in learn if term in bags[i]]
        over = sum(toxic[i] for i in have) - len(have) * rate
        if len(have) >= least and over > 0:
            chi[term] = over * over / (len(have) * rate)
    vocabulary = sorted(chi, key=lambda t: (-chi[t], t))[: toxicity.TERMS]
    idf = {t: np.log((1 + len(texts)) / (1 + sum(t in b for b in bags))) + 1 for t in vocabulary}
    x = np.array([[(1 + np.log(b[t])) * idf[t] if t in b else 0.0 for t in vocabulary] for b in bags])
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    known, blank = [i for i in learn if x[i].any()], [i for i in learn if not x[i].any()]
    base = np.mean([toxic[i] for i in known])

    def vote(i):
        others = [j for j in known if j != i and x[i] @ x[j] > 0]
        near = sorted(others, key=lambda j: -round(x[i] @ x[j], 9))[: toxicity.NEIGHBOURS]
        w = np.array([(x[i] @ x[j]) ** 2 for j in near])
        return (w @ [toxic[j] for j in near] + 0.05 * base) / (w.sum() + 0.05) if near else None, w

    own = sorted((v, toxic[i]) for i in known if (v := vote(i)[0]) is not None)
    return vote, own, blank


def test_toxicity_against_dense_search(spark):
    r = np.random.default_rng(5)
    texts = []
    for i in range(160):
        words = [f"plain{r.integers(60)}" for _ in range(25)] + ([f"nasty{r.integers(9)}slur" for _ in range(r.integers(1, 4))] if i % 4 == 0 or i % 31 == 0 else [])
        texts.append(" ".join(words))
    texts += ["", "zz"]
    toxic = {i: int(i % 4 == 0) for i in range(162)}
    labels = spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs(spark, texts), labels).collect()}
    vote, own, blank = dense_toxicity(texts, toxic)
    xs, ys = toxicity._calibrate(np.array([v for v, _ in own]), np.array([y for _, y in own], float))
    for i in range(162):
        v = vote(i)[0]
        if v is None:
            rest = [toxic[j] for j in blank if j != i]
            assert got[i]["score"] == pytest.approx((sum(rest) + 0.05) / (len(rest) + 1))
        else:
            assert got[i]["score"] == pytest.approx(min(1, max(0, 0.999 * np.interp(v, xs, ys) + 0.001 * v)), abs=1e-6), i


def test_toxicity_leaves_out_an_examples_own_label(spark):
    texts = [f"common words here nasty{'awful' if i % 3 == 0 else 'fine'}thing number{i % 7}" for i in range(90)]
    rows = [(i, 1, int(i % 3 == 0)) for i in range(90)]
    one = next(i for i in range(90) if zlib.crc32(str(i).encode()) % 5)
    scores = []
    for y in (0, 1):
        labels = spark.createDataFrame([(i, q, y if i == one else t) for i, q, t in rows], "doc_id long, quality int, toxic int")
        got = {x["doc_id"]: x for x in toxicity.toxicity(docs(spark, texts), labels).collect()}
        assert one not in got[one]["evidence"]
        scores.append(got[one]["score"])
    assert abs(scores[0] - scores[1]) < 0.2


def test_toxicity_of_few_examples(spark):
    bad = ["vilewordish", "nastythingy"]
    texts = [f"{BASE} {bad[i // 6 % 2] if i % 6 == 0 else 'fine'} t{i}" for i in range(72)]  # each word in 6 texts
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(72)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, texts), labels).collect()}
    assert [got[i]["predicted"] for i in range(72)] == [int(i % 6 == 0) for i in range(72)]


def test_patience_and_licenses(spark):
    a, b = "a b c x d e".split(), "a b q c d f e".split()
    got = licenses.patience(a, b)
    assert got == [(0, 0), (1, 1), (2, 3), (4, 4), (5, 6)]
    apache = licenses.TEMPLATES["Apache-2.0"]
    texts = [None, "", f"{BASE}\n{apache} {BASE}\n{apache}", BASE, licenses.TEMPLATES["ISC"].replace("fee", "charge")]
    rows = licenses.scan_licenses(docs(spark, texts)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [(2, "Apache-2.0"), (2, "Apache-2.0"), (4, "ISC")]
    assert texts[2][rows[0]["start"] : rows[0]["end"]].startswith("Licensed under")
    assert licenses.scan_text("İİİİİ Released under the MIT License.", {"MIT": licenses.words_of(licenses.TEMPLATES["MIT"])})[0][2] == 6


def test_license_gaps_without_anchors_are_aligned():
    """A long template whose words all occur twice has no anchors; three changed words leave one wide gap."""
    template = [f"w{i % 90}" for i in range(180)]
    words = list(template)
    for i in (5, 60, 120):
        words[i] = f"w{(i + 17) % 90}"
    words[0], words[-1] = "w3", "w3"
    aligned = licenses.patience(words, template)
    assert len(aligned) >= 174
    hits = licenses.scan_text(" ".join(words), {"long": template})
    assert [h[0] for h in hits] == ["long"]


def test_license_near_misses_skip_ahead():
    template = licenses.words_of(licenses.TEMPLATES["Apache-2.0-header"])
    text = " ".join((template[:50] + ["other"] * 5) * 40)
    every = [i for i in range(0, 2200) if len(licenses.patience(text.split()[i : i + int(1.6 * len(template)) + 1], template)) >= 0.8 * len(template)]
    hits = licenses.scan_text(text, {"x": template})
    assert bool(hits) == bool(every)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    r = np.random.default_rng(5)
    words = [[f"d{i}w{j}" for j in r.permutation(120)] for i in range(40)]
    texts = [" ".join(w) for w in words] + [" ".join(words[0]), " ".join(words[1][:-1] + ["changed"]), "short", None]
    rows = docs(spark, texts, [f"s{i % 4}" for i in range(len(texts))])
    for c_ in ("id", "host", "text_hash", "_i", "_id", "_sha", "_row", "source_size", "class", "kept"):
        rows = rows.withColumn(c_, F.lit(c_))
    rows = rows.unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(BASE)))
    columns = rows.columns
    kept = []
    for name, stage in c.STAGES:
        rows = c.pin(stage(spark, rows, SF), name)
        kept.append(rows)
        assert name == "packing" or rows.columns == columns
    assert kept[0].count() == 43 and kept[1].count() == 42 and kept[2].count() == 41 and "offset" in kept[4].columns
    assert {x["doc_id"] for x in kept[2].collect()} == {None, *range(40)}
    mixed = kept[3].groupBy("doc_id").count().collect()
    assert max(x["count"] for x in mixed) <= 2 and kept[4].select("doc_id").distinct().count() == len(mixed)


def test_pipeline_run_keeps_one_stage(spark, monkeypatch):
    import corpus_pipeline as c

    pinned = []
    monkeypatch.setattr(c, "pin", lambda df, name: pinned.append(common.pin(df, name)) or pinned[-1])
    monkeypatch.setattr(c, "STAGES", [(n, lambda spark, docs, sf_dir: docs.filter("doc_id >= 0")) for n in "abcd"])
    count = c.table(spark, SF, "documents").count()
    assert c.run(spark, SF).count() == count
    there = [fs.exists(p) for fs, p in map(common.hadoop_path, pinned)]
    assert there == [False, False, True]
