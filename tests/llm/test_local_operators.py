"""Row-wise operators against plain forms: personal data, quality figures, token counts, token files, licences, pieces."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import licence_scan, pii, piece_sampling, quality_rules, token_counts, token_output
from textloom.llm.vocabularies import public_path

SF = "/root/testdata/sf0.001"
ODD = ["a", "B", "é", "é", "H̱", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "1", "２", "ß", "İ", "Σ", "ǅ", "漢字", "…", "ﬁ", "the", "  ", "\r\n", "_", "<|", "\x00", "🙂", ".", ",", ". ", ", ", "!", "▁", "ͅ"]


def odd_texts(n, seed, parts=ODD, longest=30):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def frame(spark, texts):
    """Ids descend; columns with clashing names are added."""
    rows = [(len(texts) - k, t, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, kept int")


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append(m.span())
    return out


def test_spans_equal_the_patterns():
    for t in odd_texts(20_000, 1, ["@", ".", "a", "b-", "+", "1", "22", "255", "300", "00012", " ", "-", "(", ")", "c", "4111111111111111", "4111-1111 1111", "é", "\n", "_", "%"], 25):
        found = pii.find_spans(t)
        assert {k: found[k] for k in BASE} == plain_spans(t), t


def test_added_kinds_and_masks():
    t = 'mail a.b@x.example.com token = "2abc3ff2ca8fb1e4c565a0eb6381" account: 1234-5678-90 http://me:pw1@host.example/x'
    found = pii.find_spans(t)
    assert [t[a:b] for k in ("email", "secret", "account", "url") for a, b in found[k]] == ["a.b@x.example.com", "pw1@host.example", "2abc3ff2ca8fb1e4c565a0eb6381", "1234-5678-90", "me:pw1@host.example"]
    assert pii.masked(t) == 'mail [EMAIL] token = "[SECRET]" account: [ACCOUNT] http://[URL]/x'
    assert all(not v for v in pii.find_spans("the token of thanks, on account of 12 reasons: secret").values())


def test_pii_rows(spark):
    texts = ["x 1.2.3.4 y", None, "", "x 1.2.3.4 y", "é a@b.c " * 3000]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, texts)).collect()}
    assert got[5]["base_sha256"] == hashlib.sha256(b"ip:2:9").hexdigest() == got[2]["base_sha256"]
    assert got[4]["spans"] == "" and got[3]["n_email"] == 0 and got[1]["n_email"] == 3000
    masked = pii.mask_pii(frame(spark, texts))
    assert masked.columns == ["doc_id", "text", "n_tokens", "kept"]
    assert [r["text"] for r in masked.filter("doc_id >= 3").orderBy("doc_id").collect()] == ["", None, "x [IP] y"]
    assert pii.find_pii(frame(spark, texts).limit(0)).count() == 0


def test_quality_figures_equal_brute_force(spark):
    texts = [None, "", " \n\t", *odd_texts(300, 2, ["a", "b", "c d e", " ", "\n", "é", "#", "\x0b", "\x85", "a b c", "| "], 60)]
    rows = {r["doc_id"]: r for r in quality_rules.score(frame(spark, texts), np.zeros(1 << 16)).collect()}
    for k, t in enumerate(texts):
        r, t = rows[len(texts) - k], t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_quality_of_tiny_texts_and_of_any_partitioning(spark):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for one in ("ab", "a", "é", "abc"):
        r = quality_rules.quality_rules(spark.createDataFrame([(0, one)], "doc_id long, text string"), labels).first()
        assert (r["score"], r["n_words"], r["kept"]) == (0.0, 1, False)
    docs = spark.createDataFrame(list(enumerate(odd_texts(400, 9))), "doc_id long, text string")
    ratio = quality_rules.fit(docs, labels)
    ways = [docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1)]
    one, *others = [{r["doc_id"]: r["score"] for r in quality_rules.score(d, ratio).collect()} for d in ways]
    assert all(o == one for o in others) and len(set(one.values())) > 100


def test_log_likelihood_ratio_equals_brute_force(spark):
    config = quality_rules.QualityConfig(trusted_rows=3)
    texts = ["good words here " * 9, "other fine words " * 9, "%%% $$$ ### " * 9, "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 1), (0, 1, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    grams = [[((int.from_bytes(t.encode()[i : i + 4], "little") * 2654435761) % 2**32) >> 16 for i in range(len(t.encode()) - 3)] for t in texts]
    raw, good = Counter(sum(grams, [])), Counter(grams[0] + grams[1])
    size = 1 << 16
    prior = lambda b: (raw[b] + 1) / (sum(raw.values()) + size)
    llr = lambda b: math.log((good[b] + size * prior(b)) / (sum(good.values()) + size) / prior(b))
    got = {r["doc_id"]: r["score"] for r in quality_rules.quality_rules(docs, labels, config).collect()}
    for k, g in enumerate(grams):
        assert got[k] == pytest.approx(sum(map(llr, g)) / max(len(g), 1))
    assert not quality_rules.fit(docs, labels.limit(0)).any()
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    texts = [None, "", "x" * 3000, *odd_texts(1500, 3)]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts), token_counts.TokenCountConfig(limit=10, cache_entries=50)).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        r = got[len(texts) - k]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 10), t


def test_token_counts_of_new_characters_and_empty_tables(spark):
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    rnd = random.Random(10)
    texts = ["\U00019059's", "\U00018e08螺", *["".join(rnd.choice([chr(rnd.randrange(0x80, 0xD800)), chr(rnd.randrange(0xE000, 0x110000)), "a", "1", " ", "!", "'s"]) for _ in range(12)) for _ in range(4000)]]
    count = token_counts.merger(public_path("byte_bpe_50k.json"), 1000).count
    assert [t for t in texts if count(t) != len(library.encode(t, add_special_tokens=False).ids)] == []
    assert token_counts.token_counts(frame(spark, texts).limit(0)).count() == 0
    assert piece_sampling.add_pieces(frame(spark, texts).limit(0)).count() == 0 and licence_scan.licence_scan(frame(spark, texts).limit(0)).count() == 0


def test_token_stream_equals_the_library(spark, tmp_path):
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    texts = [None, "", *odd_texts(1500, 4)]
    docs = frame(spark, texts)
    config = token_output.TokenOutputConfig(cache_entries=400)
    got = token_output.token_output(docs, str(tmp_path / "ids"), config).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, reversed(texts)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), t
        at += len(ids)
    one = token_output.read_documents(spark, str(tmp_path / "ids"), [7])
    assert one.first()["ids"] == library.encode(texts[-7] or "", add_special_tokens=False).ids + [2]
    assert re.search(r"PushedFilters: \[[^\]]*(In\(doc_id, \[7\]\)|EqualTo\(doc_id,7\))", one._jdf.queryExecution().toString())


def test_token_files_have_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    rnd = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(str(rnd.random()) for _ in range(20))) for k in range(6000)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "ids")
    token_output.write_token_ids(docs, path, token_output.TokenOutputConfig(stripe_bytes=1 << 16, row_index_stride=1000))
    jvm, stripes, kinds = spark._jvm, 0, Counter()
    for name in tmp_path.glob("ids/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(name)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for stripe in reader.getStripes():
            stripes += 1
            footer = rows.readStripeFooter(stripe)
            kinds.update((s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList())
            assert {footer.getColumns(k).getKind().toString() for k in (1, 2, 4)} == {"DIRECT_V2"}  # run-length encoding of doc_id, seq and ids
        rows.close()
    assert stripes > len(list(tmp_path.glob("ids/*.orc"))) and kinds["BLOOM_FILTER_UTF8", 1] == stripes and kinds["ROW_INDEX", 1] == stripes
    assert not kinds["BLOOM_FILTER_UTF8", 2]


@pytest.mark.parametrize("kind,ids", [("string", ["x2", None, "x1"]), ("int", [2, None, 1]), ("decimal(20,0)", [Decimal(10**19), None, Decimal(1)])])
def test_token_stream_keeps_the_type_of_ids(spark, tmp_path, kind, ids):
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, ("b", "c c", "a"))], f"doc_id {kind}, text string")
    got = token_output.token_output(docs, str(tmp_path / "ids")).orderBy("start")
    assert dict(got.dtypes)["doc_id"] == kind and [r["doc_id"] for r in got.collect()] == [None, ids[2], ids[0]]
    assert token_output.read_documents(spark, str(tmp_path / "ids"), [ids[0]]).count() == 1


def test_other_vocabularies_are_encoded_whole(spark, tmp_path):
    assert token_output.allows_pieces(public_path("word_bpe_49k.json")) and not token_output.allows_pieces(public_path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    texts = odd_texts(100, 8)
    got = token_output.token_output(frame(spark, texts), str(tmp_path / "ids"), token_output.TokenOutputConfig(public_path("byte_bpe_50k.json"))).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {len(texts) - k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}


def test_token_stream_with_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, "c c"), (1, None)], "doc_id long, text string")
    got = token_output.token_output(docs, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 5, 5, 5]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert token_output.token_output(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_licence_texts_and_notices(spark):
    mit = licence_scan.TEXTS[0][1]
    texts = ["Copyright (c) 2020 A. Person\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE"), mit + " And more.", None, "text\n  Released under the MIT Licence!\nend", "Copyright law is dry.\n" + mit]
    got = {r["doc_id"]: r for r in licence_scan.licence_scan(frame(spark, texts)).collect()}
    assert [got[k]["licence"] for k in (5, 4, 3, 2, 1)] == ["MIT", None, None, None, None]
    assert (got[2]["notices"], got[2]["n_notice_lines"]) == ("MIT", 1)
    assert got[3]["digest"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_long_licences_are_found_whole(spark):
    texts = []
    for name, _ in licence_scan.DIGESTS:
        file = {"Artistic-1.0-Perl": "Artistic"}.get(name, name.replace(".0", "") if name[:3] in ("GPL", "LGP") else name)
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8", errors="replace") as f:
            body = f.read()
        texts += [body, "Copyright (c) 2021 A. Person\r\n" + re.sub(r"[ \t]+", "  ", body.upper()), body + " and more"]
    got = {len(texts) - r["doc_id"]: r["licence"] for r in licence_scan.licence_scan(frame(spark, texts)).collect()}
    for k, (name, _) in enumerate(licence_scan.DIGESTS):
        assert (got[3 * k], got[3 * k + 1], got[3 * k + 2]) == (name, name, None)


def test_callers_may_add_known_texts(spark, monkeypatch):
    more = spark.createDataFrame([("Own-1", "Do what you like, please."), ("Own-2", "do WHAT you like please"), ("Empty", None)], "licence string, text string")
    docs = frame(spark, ["Do what you\nlike - please!", "", "Do what you\nlike - please!"])
    for bound in (100_000, 0):
        monkeypatch.setattr(licence_scan, "BROADCAST_ROWS", bound)
        assert {r["doc_id"]: r["licence"] for r in licence_scan.licence_scan(docs, more).collect()} == {1: "Own-1,Own-2", 2: None, 3: "Own-1,Own-2"}


def test_licence_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "digest", "licence", "notices", "n_notice_lines"]
    mine = Counter(map(tuple, licence_scan.op6_licence_scan(spark, SF).select(*names).collect()))
    assert mine == Counter(duckdb.sql(licence_scan.ORACLE_SQL).project(", ".join(names)).fetchall())


def test_pieces_are_lossless_and_do_not_depend_on_partitions(spark):
    texts = [None, "", "  a  b ", "a" * 2000, " " * 300, *odd_texts(400, 5)]
    docs = frame(spark, texts)
    a = {r["doc_id"]: r for r in piece_sampling.add_pieces(docs.coalesce(1), carried=["doc_id"]).collect()}
    b = {r["doc_id"]: r for r in piece_sampling.add_pieces(docs.repartition(3), piece_sampling.PieceConfig(slice_bytes=50)).collect()}
    assert all(r["lossless"] and b[k]["pieces"] == r["pieces"] for k, r in a.items())
    assert b[1]["n_tokens"] == "x" and a[len(texts)]["n_pieces"] == 0
    encoded = piece_sampling.add_pieces(docs, carried=["doc_id"])
    back = {r["doc_id"]: r["text"] for r in piece_sampling.decode_pieces(encoded).collect()}
    assert all(back[len(texts) - k] == (t or "") for k, t in enumerate(texts))
    other = piece_sampling.add_pieces(docs, piece_sampling.PieceConfig(seed=1), carried=["doc_id"]).collect()
    assert any(r["pieces"] != a[r["doc_id"]]["pieces"] for r in other)


def test_segmentations_follow_their_weights():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "bb", "abb", "▁b"]
    v = piece_sampling.Pieces(names, [False] * 9, [True] * 9, 1.0)

    def cuts(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in names:
                yield from ((s[:k], *rest) for rest in cuts(s[k:]))

    weight = {z: math.exp(sum(v.log_weight[names.index(p)] for p in z)) for z in cuts("▁abbab")}
    n = 60_000
    ids, ends = piece_sampling.sample_texts(["abbab"] * n, np.arange(n), v, piece_sampling.PieceConfig())
    seen = Counter(tuple(names[i] for i in ids[a:b]) for a, b in zip(ends[:-1], ends[1:]))
    assert set(seen) <= set(weight)
    expected = {z: n * w / sum(weight.values()) for z, w in weight.items()}
    assert sum((seen[z] - e) ** 2 / e for z, e in expected.items()) < 40  # 13 degrees of freedom


def test_disputed_characters_are_looked_up_not_searched():
    """A million characters beyond ASCII, some beyond the least disputed one, took over ten microseconds each."""
    import time

    from textloom.llm import token_counts
    from textloom.llm.vocabularies import public_path

    counts = token_counts.merger(public_path("byte_bpe_50k.json"), 400_000)
    for text in ("é " * 500_000, "字 " * 500_000):
        begin = time.process_time()
        assert counts.find(text)[0] == text[0]
        assert time.process_time() - begin < 2.5


def test_texts_are_sent_to_sampling_once_and_masked_in_slices(spark, monkeypatch):
    """A carried text is not sent beside a copy of itself, and masking works on slices of a batch, nulls and long rows included."""
    from textloom.llm import piece_sampling, pii

    docs = spark.createDataFrame([(1, "to a@b.org now", "x"), (2, None, "y"), (3, "", "z"), (4, "plain words", None)], "doc_id long, text string, lang string")
    sampled = piece_sampling.add_pieces(docs)
    assert "__text" not in sampled._jdf.queryExecution().analyzed().toString()
    got = {r.doc_id: r for r in sampled.collect()}
    alone = {r.doc_id: r for r in piece_sampling.add_pieces(docs, carried=["doc_id"]).collect()}
    assert all(r.lossless and r.pieces == alone[k].pieces for k, r in got.items()) and got[2].text is None and got[2].n_pieces == 0
    monkeypatch.setattr(pii, "SLICE_BYTES", 5)
    assert {r.doc_id: r.text for r in pii.mask_pii(docs).collect()} == {1: pii.masked("to a@b.org now"), 2: None, 3: "", 4: "plain words"}


def test_stops_beside_signs_are_found_by_code_point():
    """The lookup equals the pattern for every sign, letter and space on either side of a stop, beyond the first 65,536 code points too."""
    import re

    pattern = re.compile(r"[.,][^\w\s]|[^\w\s][.,]|_[.,]|[.,]_").search
    some = [chr(c) for c in (*range(0x3000), 0xFF0C, 0xFF3F, 0x10000, 0x1D7D8, 0x1F600, 0x10FFFF)]
    for text in ["", ".", ",", "a.b", "a,,b", "a. ,b", "_a.", *(t for c in some for t in (f"a{c}.b", f"a,{c}b", f"{c} ."))]:
        assert token_output.stop_beside_sign(text) == bool(pattern(text)), text


def test_pieces_with_known_halves_need_no_library():
    """Signs behind a known word, or its upper case, cost no further call of the library, whatever the number of combinations."""
    vocabulary = public_path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(vocabulary), token_output.PieceEncoder(vocabulary, 1000)
    coder.encode(["one été straße $$$ ,%%% . ,"], 2)
    coder.tokenizer = coder.plain = None  # any call fails
    texts = ["ONE One$$$ ÉTÉ,%%% one,%%%\nstraße$$$ été. ONE, Straße", "", " one\t$$$ "]
    expected = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    ids, lengths = coder.encode(texts, 2)
    assert ids.tolist() == sum(expected, []) and lengths.tolist() == [len(x) for x in expected]


@pytest.mark.parametrize("entries", [5, 60, 100_000])
def test_pieces_equal_the_library_while_they_are_forgotten(entries):
    vocabulary = public_path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(vocabulary), token_output.PieceEncoder(vocabulary, entries)
    assert token_output.WIDE_SPACE.tolist() == [c for c in range(0x80, 0x110000) if chr(c).isspace()]
    some = ["the", "The", "don't", "DON'T", "x.", "a,b", "U.S.", "end.%%%", "foo$$$", "FOO!!", "<|endoftext|>", "a<|EndOfText|>", "</w>", "a</w>", "'S", "~~~é", "É!!", "œuvre", "Ÿ", "İ", "Σσ", "é", "KÅ", "7²", "中文", "да"]
    spaces, rnd = [" ", "\n", "　", "\x85", " ", " \x1c", ""], random.Random(12)
    texts = ["", "　\x1c", *("".join(rnd.choice(some) + rnd.choice(spaces) for _ in range(rnd.randrange(20))) for _ in range(1500))]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        ids, lengths = coder.encode(part, 2)
        got = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in part]


def test_token_stream_of_short_slices(spark, tmp_path):
    """Slices of a few bytes, texts longer than a slice among them, give the stream of the default ones."""
    docs = frame(spark, [None, "", "a word", "x" * 300, *odd_texts(200, 6)])
    whole = token_output.token_output(docs, str(tmp_path / "whole")).collect()
    short = token_output.token_output(docs, str(tmp_path / "short"), token_output.TokenOutputConfig(slice_bytes=50)).collect()
    assert sorted(short) == sorted(whole)
