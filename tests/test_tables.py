"""Corpus files, result tables, parity tables, slices."""

import json
import os

import pytest
from pyspark.sql import functions as F

from glossmeter import dims as D
from glossmeter.counters import api_counter, joined_text
from glossmeter.functions import text as T
from glossmeter.functions.frames import settle
from glossmeter.operators import fingerprint, measure, parity, slices
from glossmeter.plans import lifecycle as L
from glossmeter.sources import lines, tables
from glossmeter import tokenizers


def _write(path, data: bytes):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


FILES = {"plain": b"one\ntwo\n", "crlf": b"one\r\ntwo\r\n", "cr": b"one\rtwo", "bom": b"\xef\xbb\xbfone\ntwo\n",
         "open": b"one\ntwo", "blank": "one\n\n　\ntwo\n".encode(), "only": b"x", "empty": b""}


def _by_python(data: bytes, keep: bool):
    got = data.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return got if keep or got[-1] else got[:-1]


@pytest.mark.parametrize("keep", [False, True])
def test_line_files_are_read_by_position(spark, tmp_path, keep):
    for name, data in FILES.items():
        if name == "empty" or (keep and name == "cr"):
            continue
        rows = lines.read_lines(spark, _write(tmp_path / f"{name}.txt", data), keep_terminal=keep).collect()
        assert [r.text for r in sorted(rows, key=lambda r: r.line_idx)] == _by_python(data, keep), name
        assert sorted(r.line_idx for r in rows) == list(range(len(rows)))


def test_line_numbers_hold_across_file_splits(spark, tmp_path):
    texts = [f"sentence {i} " + "x" * (i % 37) for i in range(4000)]
    path = _write(tmp_path / "big.txt", ("\n".join(texts) + "\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = {r.line_idx: r.text for r in lines.read_lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(texts))


def test_blank_lines_are_named(spark, tmp_path):
    rows = lines.read_lines(spark, _write(tmp_path / "b.txt", FILES["blank"]))
    assert sorted(r.line_idx for r in lines.blank_lines(rows, ["line_idx"]).collect()) == [1, 2]


def test_split_and_flat_corpora(spark, tmp_path):
    _write(tmp_path / "a/dev/xx.dev", "óne\ntwo\n".encode())
    _write(tmp_path / "a/devtest/xx.devtest", b"three\n")
    _write(tmp_path / "b/xx.txt", b"four\nfive\n")
    units = lines.load_corpora(spark, {"a": ("splits", str(tmp_path / "a")), "b": ("flat", str(tmp_path / "b"))}, ["a", "b"], ["xx"])
    assert sorted((r.corpus, r.sentence_idx, r.text) for r in units.collect()) == [
        ("a", 0, "óne"), ("a", 1, "two"), ("a", 2, "three"), ("b", 0, "four"), ("b", 1, "five")]
    legacy = lines.split_corpus(spark, str(tmp_path / "a"), "a", ["xx"], normalise=False, keep_terminal=True)
    assert [r.text for r in legacy.orderBy("sentence_idx").collect()] == ["óne", "two", "", "three", ""]
    assert [r.lang for r in lines.languages_in(spark, str(tmp_path / "a/dev")).collect()] == ["xx"]
    with pytest.raises(FileNotFoundError, match="yy"):
        lines.flat_corpus(spark, str(tmp_path / "b"), "b", ["yy"])
    with pytest.raises(KeyError, match="c"):
        lines.load_corpora(spark, {}, ["c"], ["xx"])


def test_written_lines_read_back(spark, tmp_path):
    rows = [("xx", i, f"s{i}") for i in range(50)]
    units = spark.createDataFrame(rows, "lang string, sentence_idx bigint, text string").repartition(5)
    lines.write_lines(units, str(tmp_path / "out"))
    back = []
    for name in sorted(os.listdir(tmp_path / "out/lang=xx")):
        if name.startswith("part-"):
            back += (tmp_path / "out/lang=xx" / name).read_text().splitlines()
    assert back == [r[2] for r in rows]


@pytest.mark.skipif("PARALLEL_CORPUS_DIR" not in os.environ, reason="set PARALLEL_CORPUS_DIR to a dev/devtest corpus")
def test_published_corpus_numbers(spark):
    """2009 sentences; known code points, bytes and share of joining spaces."""
    units = lines.split_corpus(spark, os.environ["PARALLEL_CORPUS_DIR"], "c", ["eng_Latn", "zho_Hans"]).cache()
    assert lines.blank_lines(units, ["lang", "sentence_idx"]).count() == 0
    got = {r.lang: (r.n, r.chars, r.bytes) for r in units.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(T.char_count(F.col("text"))).alias("chars"), F.sum(T.byte_count(F.col("text"))).alias("bytes")).collect()}
    assert got == {"eng_Latn": (2009, 257160, 257386), "zho_Hans": (2009, 85435, 238065)}
    assert [round(2008 / (got[l][1] + 2008) * 100, 2) for l in got] in ([0.77, 2.30], [2.30, 0.77])
    legacy = lines.split_corpus(spark, os.environ["PARALLEL_CORPUS_DIR"], "c", ["eng_Latn"], keep_terminal=True)
    assert legacy.count() == 2011


def test_result_tables_tolerate_older_columns(spark, tmp_path):
    path = _write(tmp_path / "raw.csv", b"corpus,counter_id,lang,sentence_idx,n_tokens,n_chars\nc,a,x,0,5,3\n")
    rows = tables.read_csv_optional(spark, path, tables.RAW_SCHEMA)
    assert rows.first().n_tokens == 5 and "n_tokens_content" not in rows.columns
    assert tables.read_csv_optional(spark, str(tmp_path / "absent.csv"), tables.RAW_SCHEMA) is None
    with pytest.raises(ValueError, match="corpus"):
        tables.read_csv_optional(spark, _write(tmp_path / "old.csv", b"counter_id,lang\na,x\n"), tables.RAW_SCHEMA)
    assert tables.read_json(spark, _write(tmp_path / "m.json", b"{broken")) == {}
    tables.write_json(spark, {"a": "é"}, str(tmp_path / "n.json"))
    assert tables.read_json(spark, str(tmp_path / "n.json")) == {"a": "é"}


def test_partitioned_facts_replace_only_what_was_written(spark, tmp_path):
    schema = "corpus string, counter_id string, lang string, n bigint"
    path = str(tmp_path / "facts")
    tables.write_partitioned(spark.createDataFrame([("c", "a", "x", 1), ("c", "b", "x", 2)], schema), path)
    tables.write_partitioned(spark.createDataFrame([("c", "b", "x", 3)], schema), path)
    assert sorted((r.counter_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_fingerprints_see_text_order_and_language(spark):
    def prints(rows):
        units = spark.createDataFrame(rows, "corpus string, lang string, sentence_idx bigint, text string")
        digests = units.withColumn("digest", F.sha2("text", 256))
        return fingerprint.corpus_fingerprints(digests, ["x", "y"]).first().fingerprint, units
    rows = [("c", l, i, f"{l}{i}") for l in "xy" for i in range(5)]
    base, units = prints(rows)
    assert prints(rows[::-1])[0] == base
    assert prints([(c, l, i, t + " " if i == 3 else t) for c, l, i, t in rows])[0] != base
    assert prints([(c, l, 4 - i, t) for c, l, i, t in rows])[0] != base
    import hashlib
    flat = hashlib.sha256(b"".join(l.encode() + b"\0" + "\n".join(f"{l}{i}" for i in range(5)).encode() + b"\0" for l in "xy"))
    assert fingerprint.flat_fingerprints(units, ["x", "y"]).first().sha256 == flat.hexdigest()


def test_joined_text_is_refused_over_its_limit(spark):
    units = spark.createDataFrame([("c", "x", 1, "bb"), ("c", "x", 0, "a")], "corpus string, lang string, sentence_idx bigint, text string")
    assert joined_text(units).first().text == "a bb"
    with pytest.raises(ValueError, match="limit"):
        joined_text(units, limit=2)


def test_envelope_floor_rules(spark):
    def frames(frame, multi=()):
        return [(p, frame + (2 if p in multi else 1)) for p in D.ENVELOPE_PROBES]
    cases = {"plain": frames(6), "digits": frames(7, ("7", "0")), "upper": frames(6, ("Z",)),
             "ambiguous": frames(6, D.ENVELOPE_PROBES[1:]), "absurd": frames(65)}
    df = spark.createDataFrame([(k, p, n) for k, v in cases.items() for p, n in v], "k string, probe string, n_tokens bigint")
    got = {r.k: (r.envelope_tokens, r.verdict) for r in measure.envelope_floors(df, ["k"]).collect()}
    assert got == {"plain": (6, "ok"), "digits": (7, "ok"), "upper": (6, "ok"), "ambiguous": (6, "ambiguous"), "absurd": (65, "implausible")}
    for k, v in cases.items():
        one = settle({p: n - D.ENVELOPE_PROBE_TOKENS for p, n in v})
        assert (one.tokens, one.verdict) == got[k]


def test_frame_of_an_endpoint(spark):
    calls = []

    def client():
        def count(text):
            calls.append(text)
            return len(text) + 8
        return count

    counter = api_counter("beta", "b", client)
    assert counter.frame == 8 and calls == list(D.ENVELOPE_PROBES)           # one call a probe
    texts = spark.createDataFrame([("abc",), (None,)], "text string")
    assert [r[0] for r in texts.select(counter.content(F.col("text"))).collect()] == [3, None]
    with pytest.raises(RuntimeError, match="implausible"):
        api_counter("beta", "b", lambda: lambda text: len(text) + 65)


def test_slice_keeps_last_clean_duplicate_in_every_locale(spark):
    records = [("en", "2", "dev", " b ", 0), ("en", "10", "dev", "a", 1), ("en", "10", "dev", "a2", 2), ("en", "10", "dev", "bad\nline", 3),
               ("en", "3", "test", "t", 4), ("de", "10", "dev", "ö", 0), ("de", "2", "dev", "x", 1), ("de", "7", "dev", " \t", 2)]
    df = spark.createDataFrame(records, "locale string, id string, partition string, utt string, pos bigint")
    clean = slices.clean_utterances(df)
    kept = slices.parallel_slice(clean, 2).orderBy("locale", "order").collect()
    assert [(r.locale, r.order, r.utt) for r in kept] == [("de", 2, "x"), ("de", 10, "ö"), ("en", 2, "b"), ("en", 10, "a2")]
    assert {r.locale: r.n_dropped for r in slices.dropped_per_locale(clean, 2).collect()} == {"en": 0, "de": 0}


def test_parallel_corpus_from_json_lines(spark, tmp_path):
    for loc in ("en", "de"):
        rows = [{"id": str(i), "locale": loc, "partition": "dev", "utt": f"{loc} {i}"} for i in (11, 2, 1) if (loc, i) != ("de", 1)]
        _write(tmp_path / f"{loc}.jsonl", "\n".join(map(json.dumps, rows)).encode())
    records = tables.read_records(spark, [str(tmp_path / "en.jsonl"), str(tmp_path / "de.jsonl")])
    L.parallel_corpus(records, 2, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted((r.lang, r.value) for r in back) == [("de", "de 11"), ("de", "de 2"), ("en", "en 11"), ("en", "en 2")]


def test_the_last_record_wins_whatever_order_files_are_read_in(spark, tmp_path):
    """Spark packs large files first; the order is that of the files as they are named."""
    def file(name, n, word):
        rows = [{"id": str(i), "locale": "en", "partition": "dev", "utt": f"{word} {i} " + "x" * 200} for i in range(n)]
        _write(tmp_path / name, "\n".join(map(json.dumps, rows)).encode())
        return str(tmp_path / name)
    small, large = file("b.jsonl", 3, "small"), file("a.jsonl", 4000, "large")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        for paths, last in (([small, large], "large"), ([large, small], "small"), ([str(tmp_path)], "small")):
            rows = tables.read_records(spark, paths).where("id in ('0', '2', '9')").collect()
            won = {}
            for r in sorted(rows, key=lambda r: r.pos):
                won[r.id] = r.utt.split()[0]
            assert won == {"0": last, "2": last, "9": "large"}, paths
            assert len({r.pos for r in rows}) == len(rows) == 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parity_tables_with_a_model_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "one": 1, "two": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "model.json")
    tok.save(path)
    units = spark.createDataFrame([("x", 0, "one"), ("x", 1, "two"), ("y", 0, "one zzzzzz"), ("z", 0, "one")],
                                  "lang string, sentence_idx bigint, text string")
    names = spark.createDataFrame([("x", "Xish"), ("y", " Yish ")], "lang string, language string")
    additive = [parity.ParityTokenizer("UTF-32", T.char_count, 1)]
    codec = tokenizers.CodecTokenizer("Tiny", lambda: tokenizers.from_tokenizers_file(path, "[UNK]"))
    out = L.parity_tables(L.Results(spark, str(tmp_path / "res")), units, names, additive, [codec])
    assert sorted(map(tuple, out["tokenization_lengths"].collect())) == [("Xish", 7, 2), ("Yish", 10, 2)]
    # "one zzzzzz" decodes to "one" without its unknown token: 2 * 7 / 10 tokens are unknown
    assert sorted(map(tuple, out["tokenization_unknown"].collect())) == [("Xish", 0, 0), ("Yish", 0, 1)]
    assert sorted(map(tuple, out["tokenization_lengths_validated"].collect())) == [("Xish", "7", "2"), ("Yish", "10", "–––")]
    back = tables.read_masked(spark, str(tmp_path / "res/tokenization_lengths_validated.csv")).collect()
    assert [(r.language, r["Tiny"]) for r in back] == [("Xish", 2.0), ("Yish", None)]


def test_relative_lengths_follow_each_target(spark):
    cells = spark.createDataFrame([("English", "A", 10), ("German", "A", 15), ("English", "B", 4), ("German", "B", 8),
                                   ("English", "C", 4), ("German", "C", None)], "language string, tokenizer string, n_tokens bigint")
    got = {(r.language, r.tokenizer): r.relative for r in parity.relative(cells, {"B": "German", "C": "German"}, "English").collect()}
    assert got == {("English", "A"): 1.0, ("German", "A"): 1.5, ("English", "B"): 0.5, ("German", "B"): 1.0,
                   ("English", "C"): None, ("German", "C"): None}


def test_language_map_and_codes(spark, tmp_path):
    path = _write(tmp_path / "map.csv", b"Language, Code\nStandard Arabic , arb_Arab\n Dutch, nld_Latn\n")
    assert sorted(map(tuple, tables.read_language_map(spark, path).collect())) == [("arb_Arab", "Standard Arabic"), ("nld_Latn", "Dutch")]
    codes = lines.read_codes(spark, _write(tmp_path / "rtl.txt", b"arb_Arab \nheb_Hebr\n"))
    assert sorted(r.lang for r in codes.collect()) == ["arb_Arab", "heb_Hebr"]


def test_codec_unknown_marks():
    assert tokenizers.without([5, 248059, 1, 248059, 12], tokenizers.SEAMLESS_UNKNOWN) == [5, 248059, 12]
    assert tokenizers.without([0, 3, 0], (0,)) == [3]
    assert tokenizers.available("ByT5")[0] is None and tokenizers.available("nothing")[0] is None
    assert len(D.PARITY_TOKENIZERS) == 27
    named = set(tokenizers.HF_MODELS) | set(tokenizers.TIKTOKEN_NAMES) | {"SeamlessM4T", "UTF-32"}
    assert named == set(D.PARITY_TOKENIZERS)


def test_a_flat_fingerprint_goes_on_from_part_to_part(spark, monkeypatch):
    """No task goes through more than some of the parts, and the digest is that of the whole."""
    import hashlib
    rows = [(c, l, i, f"{c}{l}{i}é" * (i % 7)) for c in "cd" for l in "xy" for i in range(60)]
    units = spark.createDataFrame([*rows, ("c", "x", 60, None), ("c", "z", 0, "left out")], "corpus string, lang string, sentence_idx bigint, text string").repartition(5)
    made, real = [], fingerprint.staged
    monkeypatch.setattr(fingerprint, "staged", lambda frame, **more: made.append(real(frame, **more)) or made[-1])
    got = {r.corpus: r.sha256 for r in fingerprint.flat_fingerprints(units, ["x", "y"], part_bytes=500).collect()}
    want = {c: hashlib.sha256(b"".join(l.encode() + b"\0" + "\n".join([t for k, m, _, t in rows if (k, m) == (c, l)] + [""] * ((c, l) == ("c", "x"))).encode()
                                       + b"\0" for l in "xy")).hexdigest() for c in "cd"}
    assert got == want
    assert max(r["count"] for r in made[0].groupBy("part").count().collect()) < 60
    assert fingerprint.flat_fingerprints(units.limit(0), ["x", "y"]).count() == 0
