"""Operators with exact results, against plain Python or the libraries, over small awkward tables: nulls, empty and long texts, ties,
repeated rows, empty tables, and columns whose names clash with those of results."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, decontamination, line_templates, ngram_join, registry, sentence_pieces, sharding, token_store

SF = "/root/testdata/sf0.001"
COMMON = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [
    None, "", " ", "word", "two words", COMMON, COMMON, COMMON + " more", COMMON.upper(), "\n\n \t", "日本語 テキスト é à 🎉", "x" * 30_000, "a b " * 6_000, "  lead  and  trail  ",
    "Licensed under the Apache License, Version 2.0.\nown line of this text here", "Licensed under the Apache License, Version 3.1.\nanother line of that text there", "▁ <s> </s> <unk> <|endoftext|> don't 12 34",
]


def table(spark, texts=TEXTS, more=""):
    rows = [(k, t, "kept", 7) for k, t in enumerate(texts)] + [(None, COMMON, "kept", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@cache
def piece_model():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@cache
def byte_model():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_are_the_library_s(spark):
    got = sentence_pieces.encode(table(spark).withColumn("ids", F.lit("clash"))).collect()
    assert len(got) == len(TEXTS) + 1 and {"source", "n_words"} <= set(got[0].asDict())
    for r in got:
        ids = piece_model().encode(r.text or "")
        assert r.ids == ids and r.decoded == piece_model().decode(ids)
    assert sentence_pieces.encode(table(spark).limit(0)).count() == 0


def test_pieces_of_random_texts():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab ▁\n.tinhe,1é日  "), rng.integers(0, 80))) for _ in range(2000)]
    ids, offs = sentence_pieces.loaded(None).encoded([t.encode() for t in texts])
    assert all(ids[a:b].tolist() == piece_model().encode(t) for t, a, b in zip(texts, offs[:-1], offs[1:], strict=True))


def test_segments_of_random_texts():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab  \n.'s1é日  \t×,-ß  "), rng.integers(0, 60))) for _ in range(4000)]
    ids, offs = token_store.encoded([t.encode() for t in texts])
    assert all(ids[a:b].tolist() == e.ids for e, a, b in zip(byte_model().encode_batch(texts, add_special_tokens=False), offs[:-1], offs[1:], strict=True))


def test_store_gives_back_what_was_put_in(spark, tmp_path):
    df = table(spark, [*TEXTS, *TEXTS[5:7]])
    token_store.write_store(df, str(tmp_path / "s"))
    got = token_store.read_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    texts = [COMMON, *TEXTS, *TEXTS[5:7]]  # a null doc_id comes first
    start = 0
    for r, text in zip(got, texts, strict=True):
        ids = byte_model().encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    chunks = spark.read.parquet(str(tmp_path / "s/chunks"))
    assert chunks.count() == chunks.select("digest").distinct().count()
    top = spark.read.parquet(str(tmp_path / "s/manifest")).where("part = -1").orderBy(F.desc("level")).first()
    assert (top.n_docs, top.n_tokens) == (len(texts), start)


@pytest.mark.parametrize("fan", [1024, 2])
def test_store_notices_what_was_changed(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(token_store, "FAN", fan)
    token_store.write_store(table(spark), str(tmp_path / "a"))
    assert token_store.read_store(spark, str(tmp_path / "a")).count() == len(TEXTS) + 1
    kept = {name: spark.read.parquet(str(tmp_path / "a" / name)) for name in ("chunks", "recipes", "manifest")}
    chunks, recipes, manifest = kept.values()
    one, other = chunks.orderBy("n").first(), chunks.orderBy(F.desc("n")).first()
    first = recipes.orderBy("start").first()
    longest = recipes.orderBy(F.desc("n_tokens")).first()
    altered = F.col("row_id") == first.row_id
    changes = {
        "chunk": ("chunks", chunks.withColumn("ids", F.when(F.col("digest") == F.lit(one.digest), F.lit(other["ids"])).otherwise(F.col("ids"))), "root in the recipes"),
        "lost chunk": ("chunks", chunks.where(F.col("digest") != F.lit(one.digest)), "root in the recipes"),
        "lost document": ("recipes", recipes.where(~altered), "manifest"),
        "altered recipe with its root": ("recipes", recipes.where(~altered).unionByName(recipes.where(F.col("row_id") == longest.row_id).withColumns({c: F.lit(first[c]) for c in ("doc_id", "row_id", "start", "place", "part")})), "manifest"),
        "lost part": ("recipes", recipes.where(F.col("part") != first.part), "manifest"),
        "lost nodes": ("manifest", manifest.where("level > 1"), "manifest"),
    }
    for what, (name, rows, error) in changes.items():
        base = str(tmp_path / what.replace(" ", "-"))
        for folder, df in kept.items():
            (rows if folder == name else df).write.parquet(f"{base}/{folder}")
        with pytest.raises(Exception, match=error):
            token_store.read_store(spark, base).collect()
    with pytest.raises(ValueError, match="lacks its manifest"):
        token_store.read_store(spark, str(tmp_path / "nothing"))


def test_other_vocabularies_are_encoded_as_the_library_does(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    texts = [t or "" for t in TEXTS]
    ids, offs = token_store.encoded([t.encode() for t in texts], str(path))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]


def test_remembered_segments_are_short():
    token_store.encoded([("z" * 5000 + " short 日本語" * 900).encode()])
    assert max(len(s) for side in token_store._recent[None] for s in side) <= token_store.REMEMBERED_BYTES


def doubled(n, a="a", b="b"):
    """A text of two letters and its complement, which polynomial hashes modulo a power of two take for equal."""
    s = a
    for _ in range(n):
        s += s.translate(str.maketrans(a + b, b + a))
    return s, s.translate(str.maketrans(a + b, b + a))


def test_texts_that_fool_polynomial_hashes(spark):
    texts = [*doubled(10), *doubled(12), *("x y z " + t for t in doubled(10)), *(" ".join(t) for t in doubled(10))]
    raw = [t.encode() for t in texts]
    for encoded, want in ((sentence_pieces.loaded(None).encoded, piece_model().encode), (token_store.encoded, lambda t: byte_model().encode(t, add_special_tokens=False).ids)):
        ids, offs = encoded(raw)
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [want(t) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(table(spark, texts)).collect() if r.doc_id is not None}
    assert got == components(enumerate(texts))
    items = [(1, doubled(10)[0]), (2, "x y z " + doubled(10)[1])]
    for r in decontamination.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).where("doc_id is not null").collect():
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == hits(texts[r.doc_id], items)


def test_kinds_of_spans_are_told_apart_by_their_bytes(monkeypatch):
    words = ["a", "b", "abcdefgh", "abcdefgi", "abcdefghi", "abcdefghj", "a", "long word of many letters", "long word of many lettert"]
    buf, begins = common.buffer_of([w.encode() for w in words])
    for hashed in (common.span_hashes, lambda buf, starts, ends: np.zeros(len(starts), np.uint64)):
        monkeypatch.setattr(common, "span_hashes", hashed)
        first, kind = common.distinct_spans(buf, begins[:-1], begins[1:] - 1)
        assert [words[first[k]] for k in kind] == words and len(first) == len(set(words))


def test_empty_store(spark, tmp_path):
    token_store.write_store(table(spark).limit(0), str(tmp_path / "e"))
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


def components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    lists = defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in lists[x]).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            lists[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(n, words, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            own[rng.integers(0, words)] = f"v{rng.integers(0, 9999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [512, 5])
def test_join_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 40)
    texts = [*TEXTS, *near_copies(60, 80, 4, 1), *near_copies(40, 30, 2, 2), *near_copies(30, 200, 12, 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(table(spark, texts)).collect()}
    assert got.pop(None) == (16, None)
    assert got == components(enumerate(texts))


def test_join_of_nothing(spark):
    assert ngram_join.linked_components(table(spark).limit(0)).count() == 0


def hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w = find(text)
    hit, names = set(), set()
    for name, item in items:
        v = find(item)
        n = min(13, len(v))
        for window in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window:
                    hit.update(range(k, k + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [4 << 20, 150])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    items = [(1, COMMON), (2, "word"), (3, None), (None, COMMON), (4, ""), (10, "gamma delta"), (5, COMMON.split(" ", 3)[3]), (5, "two words")]
    texts = [*TEXTS, f"before {COMMON} after, Gamma-Delta! word", "x " * 500 + COMMON]
    found = decontamination.decontaminate(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    for r in found.where("doc_id is not null").collect():
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == hits(texts[r.doc_id], [x for x in items if x[0] is not None]), texts[r.doc_id]
    none = decontamination.decontaminate(table(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0 or contaminated").count() == 0
    assert decontamination.decontaminate(table(spark).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_lines(spark):
    long_line = " ".join(f"token{k}" for k in "abcdefghijklmnopqrst")
    other = long_line.replace("tokent", "changed")
    texts = [None, "", f"own words of the first\n{long_line}", f"{long_line}\nother words here", f"{other}\nx", "Printed page 3 of 10 altogether", "Printed page 4 of 10 altogether", "short\nof", "short\nof"]
    got = {r.doc_id: r for r in line_templates.drop_recurring(table(spark, texts).withColumn("n_lines", F.lit(99))).collect()}
    assert got[2].text == texts[2] and got[3].text == "other words here" and got[4].text == "x" and got[6].text == "" and got[7].text == texts[7] == got[8].text
    assert got[0].text is None and (got[0].n_lines, got[0].n_dropped) == (0, 0) and (got[3].n_lines, got[3].n_dropped) == (2, 1)
    assert got[2].source == "kept"
    assert line_templates.drop_recurring(table(spark).limit(0)).count() == 0


def test_passages_inside_other_lines(spark):
    """A passage of over 50 words recurs in lines of other lengths and beginnings; an edit leaves the sentence that holds it in its template."""
    rng = np.random.default_rng(8)
    sentence = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n)).capitalize() + "."
    passage = [sentence(18) for _ in range(4)]
    edited = [p.replace(p.split(" ")[6], "edited").replace(p.split(" ")[12], "other") for p in passage]
    own = [sentence(11) for _ in range(6)]
    texts = [f"{own[0]} {' '.join(passage)} {own[1]}", f"{own[2]} {own[3]} {' '.join(passage)}\n{own[4]}", f"{' '.join(edited)} {own[5]}"]
    got = {r.doc_id: r for r in line_templates.drop_recurring(table(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == f"{own[2]} {own[3]} {own[4]}" and got[2].text == own[5]
    assert (got[1].n_lines, got[1].n_dropped) == (7, 4)


@pytest.mark.parametrize("hot", [512, 1])
def test_lines_of_awkward_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(line_templates, "HOT", hot)
    line = "A recurring sentence with several longer words stands here"
    rows = [(1, line, 1), (1, f"{line}\nof the same document", 1), (2, line, 1), (2, line, 1), (None, f"{line}\nlast", 1), (3, "z" * 20_000, 1), (4, "z" * 20_000, 1)]
    got = sorted((r.doc_id or 9, r.text, r.n_dropped) for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string, drops_ int")).collect())
    assert got == [(1, line, 0), (1, f"{line}\nof the same document", 0), (2, "", 1), (2, "", 1), (3, "z" * 20_000, 0), (4, "", 1), (9, "last", 1)]


def test_lines_with_an_edit_in_each_half(spark):
    words = [f"token{k}" for k in "abcdefghijklmnopqrstuvwx"]
    texts = [f"own line\n{' '.join(words)}"]
    for a, b in ((4, 13), (4, 22), (9, 13), (9, 22)):
        texts.append(" ".join("edited" if k in (a, b) else w for k, w in enumerate(words)) + "\nx")
    texts.append(" ".join(w if k < 3 else f"other{w}" for k, w in enumerate(words)))
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(table(spark, texts)).collect()}
    assert got[0] == texts[0] and [got[k] for k in range(1, 5)] == ["x"] * 4 and got[5] == texts[5]


def test_lines_are_parsed_once(spark):
    """No filter works out a piece a second time, and a text is hashed before it is cut, not once for each piece."""
    plan = line_templates.parsed(table(spark))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Filter" in x and ("regexp_replace" in x or "split(" in x)]
    at = lambda what: [k for k, x in enumerate(plan) if what in x]
    assert min(at("xxhash64(text")) > max(at("posexplode"))


def test_pieces_and_tokens_of_awkward_white_space(spark):
    texts = ["one.\ntwo. three!\tfour? five!  six\x1eseven. \x1e\n\n eight. \nnine", "", ".", ". ", "\x1e", "a. b", "? \n! ", "no cut at all.", "日本語。 é! ü? \n"]
    want = [re.split("\x1e", re.sub("(\n|[.!?] )", "\\1\x1e", t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", line_templates.pieces_of(F.col("text")).alias("x"))
    assert [r.x for r in df.orderBy("doc_id").collect()] == want
    assert [r.n_lines for r in line_templates.drop_recurring(table(spark, texts)).where("doc_id is not null").orderBy("doc_id").collect()] == [len(w) for w in want]
    # Each is the same template as the first, however its white space and variable fields are written.
    like = "several longer words 12a <*> b7 stand\there \x0b at 3 \n"
    texts = [like, "  several longer words  x1 y2z b7 stand here at 44.5", "several\tlonger words 1 2 3 stand here at 9\r\f\n", "several longer words 12a b7 stand here at 3"]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(table(spark, texts)).collect()}
    assert [got[k] for k in range(4)] == [like, "", "", texts[3]]
    keys = {r.key for r in line_templates.parsed(table(spark, ["1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 9 10", "z" * 20_000 + "1 " + "z" * 20_000])).where("doc < 9").collect()}
    assert len(keys) == 2  # the first is too short as it stands, though not with its fields replaced


def test_short_lines_recur_at_every_size(spark):
    short, long = "we all saw it in may and june", "これは空白のない一行の長い文章です" * 5
    texts = [f"{short}\nown{k}" for k in range(10)] + [f"{long}\nfirst", f"{long}\nsecond"]
    rest = spark.range(100, 22_100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(table(spark, texts).select("doc_id", "text").where("doc_id is not null").unionAll(rest)).where("doc_id < 100").collect()}
    assert got[0] == texts[0] and [got[k] for k in range(1, 10)] == [f"own{k}" for k in range(1, 10)]
    assert got[10] == texts[10] and got[11] == "second"


def test_joins_without_a_hot_key_are_plain(spark):
    """Keys with a large share of the rows meet a broadcast; without any there is one join and nothing is read twice. Both give a join's rows."""
    table_ = spark.range(0, 2_000, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    for hot in (False, True):
        rows = spark.range(1_500).select("id", (F.when(F.col("id") % 3 == 0, 4).otherwise(F.col("id")) if hot else F.col("id")).alias("k"))
        for how in ("inner", "left"):
            got = ngram_join.spread(rows, table_, "k", how)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table_, "k", how).collect()), key=str)
            assert hot == ("Union" in got._jdf.queryExecution().optimizedPlan().toString())


def test_shards(spark):
    texts = [*TEXTS, *["copy"] * 50, *(f"text {k}" for k in range(100)), *(f"pair {k // 2}" for k in range(40))]
    rows = sharding.shard_by_text(table(spark, texts), 8).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) + 1 and len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    own = {r.doc_id: r for r in rows}
    assert all(own[k].size == len((t or "").encode()) + 8 and own[k].text_crc32 == zlib.crc32((t or "").encode()) for k, t in enumerate(texts))
    pairs = [k for k in range(len(texts) - 40, len(texts), 2) if own[k].shard != own[k + 1].shard]
    assert len(pairs) <= 7  # only groups at a quota's edge are cut
    assert sharding.shard_by_text(table(spark).limit(0), 8).count() == 0


def test_rounds_cut_fewer_links_and_large_groups_are_fanned(spark):
    texts = [*["copy"] * 300, *(f"pair {k // 2}" for k in range(60)), *(f"text {k}" for k in range(40))]
    df = spark.createDataFrame([(k % 350, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, size int")
    rows = sharding.stored(sharding.text_groups(df.drop("size")), "rows")
    fans = rows.groupBy("group", "fan").count().collect()
    assert max(r["count"] for r in fans) <= 10 and len(fans) > 100
    links = sharding.equal_text_links(rows)
    cut = [sharding.cut_links(sharding.propagate(rows, links, 8, rounds), links).first() for rounds in (0, 3)]
    assert cut[0]["links"] == cut[1]["links"] == 299 + 30 and cut[1].cut < 0.8 * cut[0].cut
    assert len(sharding.shard_by_text(df, 8).collect()) == len(texts)


def test_registered_queries_that_no_sql_says(spark):
    """op5, op8 and op9 as registered: columns, types and every row, against plain Python."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    run = lambda name: registry.queries()[name](spark, SF)
    got = run("op5_sharding")
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = got.collect()
    counts = Counter(r.shard for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None} and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(k, len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in docs.items()}
    got = run("op8_ngram_join")
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(docs.items())
    got = run("op9_token_store")
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    start = 0
    for r in got.orderBy("doc_id").collect():
        ids = [*byte_model().encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def test_digests_of_the_pieces_query(spark):
    got = {r.doc_id: r for r in registry.queries()["op10_sentence_pieces"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        ids = piece_model().encode(r.text)
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
