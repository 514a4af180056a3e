"""The contract's digests against plain single-process versions, over whole tables."""

import base64
import glob
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm import catalogue, licenses, media, packing, repair, secrets, simhash, tokens, warc
from weir.llm.common import flat_bytes


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def token_bytes(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], "<u4").tobytes() for e in t.encode_batch(text, add_special_tokens=False)]


SPECIAL = ["", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "before <|endoftext|> after", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end", "plain words, 'll it's they're.. 12 x\u00e9\u00c9 \x01\x02", "\u3000wide\u2003spaces\x85\x1c", "\u6f22\u5b57 \U0001f600 \u0130 e\u0301 \ufb01 \u00d7\u00f7"]


@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["word", "The", " ", "  ", "\n", "'s", "'Re", "\u00e9", "\u00dc", "7", "...", "<|endoftext|>", "\xa0", "\x00", "\u4e2d"]), max_size=12).map("".join)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoders_are_the_library(found):
    """Both vocabularies, special strings included, as the library alone gives them."""
    found = [x.encode("utf-8", "ignore").decode() for x in found] + SPECIAL
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids, bounds = tokens.encoder(public_tokenizers.path(name)).encode(*flat_bytes(pa.array(found, pa.string())), 3)
        assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == token_bytes(name, found, 3)


def test_every_entry_of_the_word_vocabulary_is_its_own_word():
    """What lets merges by rank stand for merges by pair: an entry's characters merge to that entry."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = [library.id_to_token(i) for i in range(512, 49_406)]
    assert all([t.id for t in library.model.tokenize(e.removesuffix("</w>"))] == [512 + k] for k, e in enumerate(own) if e.endswith("</w>"))


def check_packing(found, docs):
    expected = {}
    for (doc_id, _), ids in zip(docs, token_bytes("byte_bpe_50k.json", [t for _, t in docs], 0), strict=True):
        expected.setdefault(doc_id, []).append(ids)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(expected)
    for doc_id, pieces in by_doc.items():
        # Repeated ids: each (start, length, crc) as often as the documents give it.
        want = sorted((a, min(1024, len(ids) // 4 - a), zlib.crc32(ids[4 * a : 4 * a + 4096]), len(ids) // 4) for ids in expected[doc_id] for a in range(0, len(ids) // 4, 1024))
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    at = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 1024 for n in at.values())
    return sum(at.values()) / (1024 * len(at))


def test_packing(spark, sf_dir, documents):
    assert check_packing(rows_of(catalogue.op2_packing(spark, sf_dir)), texts(documents)) > 0.97


def test_packing_odd(odd, clashing, empty):
    check_packing(rows_of(packing.pack(odd)), texts(odd))
    check_packing(rows_of(packing.pack(clashing, group_docs=3)), texts(odd))
    special = odd.sparkSession.createDataFrame([*enumerate(SPECIAL), *[(None, "")] * 300], "doc_id long, text string")
    check_packing(rows_of(packing.pack(special, group_docs=20)), texts(special))
    check_repair(rows_of(repair.token_table(special)), texts(special))
    assert packing.pack(empty).count() == 0


def test_first_fit_is_first_fit():
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, placed = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(100)
        placed[i] = (k, 100 - room[k])
        room[k] -= sizes[i]
    assert [placed[i] for i in range(len(sizes))] == list(zip(bins.tolist(), offsets.tolist(), strict=True))


def check_repair(found, docs):
    packed = token_bytes("word_bpe_49k.json", [t for _, t in docs], 2)
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    at, want = 0, {}
    for k in order:
        want.setdefault(docs[k][0], []).append((len(packed[k]) // 4, zlib.crc32(packed[k])))
    got = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [docs[k][0] for k in order]
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())


def test_repair(spark, sf_dir, documents):
    check_repair(rows_of(catalogue.op5_repair(spark, sf_dir)), texts(documents))


def test_repair_odd(odd, clashing, empty):
    check_repair(rows_of(repair.token_table(odd, shard_tokens=50)), texts(odd))
    check_repair(rows_of(repair.token_table(clashing)), texts(odd))
    assert repair.token_table(empty).count() == 0


def frequent_pairs(symbols, ends, least):
    """Pairs with at least that many places in documents, those of two equal symbols aside, which may overlap."""
    code = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
    inside = np.ones(len(code), bool)
    inside[ends[(ends > 0) & (ends < len(symbols))] - 1] = False
    pairs, n = np.unique(code[inside], return_counts=True)
    return [p for p in pairs[n >= least].tolist() if p >> 32 != p & 0xFFFFFFFF]


@pytest.mark.parametrize("least", [2, 4])
def test_repair_leaves_no_frequent_pair(spark, sf_dir, documents, least):
    """Pairs are replaced until none occurs often, whatever the number of rounds; texts get shorter by a third and more."""
    packed = b"".join(token_bytes("word_bpe_49k.json", [t for _, t in texts(documents)], 2))
    ids = np.frombuffer(packed, "<u4")
    ends = np.flatnonzero(ids == 2) + 1
    for some, stops in ((ids, ends), (np.tile(ids[:500], 400), np.arange(500, 200_001, 500)), (np.zeros(1000, np.uint32), np.array([1000]))):
        symbols, bounds, base, rules = repair.compress(some, stops, least)
        assert not frequent_pairs(symbols, bounds, least)
        lengths = repair.expansion_lengths(base, rules)
        assert (repair.Expander(base, rules, lengths).expand(symbols) == some).all()
        assert len(symbols) < 0.65 * len(some)


@pytest.mark.parametrize("vocabulary", [3, 40, 49_000])
def test_repair_shards_decode_anywhere(vocabulary):
    draw = np.random.default_rng(vocabulary)
    docs = [draw.integers(0, vocabulary, n).astype("<u4") for n in (5, 0, 1, 4000, 2, 7000)]
    data = repair.write_shard(list(range(len(docs))), np.concatenate(docs), np.array([len(d) for d in docs]))
    shard = repair.read_shard(data)
    expander = repair.Expander(shard.base, shard.rules, shard.lengths)
    for k in (3, 0, 5, 1, 4, 2):
        assert repair.document(shard, k, expander).tolist() == docs[k].tolist()
    if vocabulary < 100:
        assert len(shard.rules) and len(shard.symbols) < sum(map(len, docs))


def brute_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check_secrets(found, docs):
    want = sorted(((i is not None, i or 0), [sum(k == x for _, k, _ in s) for x in range(3)], hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()) for i, t in docs for s in [brute_secrets(t)])
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), [r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) for r in found)
    assert got == want


def test_secrets(spark, sf_dir, documents):
    found = rows_of(catalogue.op3_secret_scan(spark, sf_dir))
    check_secrets(found, texts(documents))


def test_secrets_odd(odd, clashing, empty):
    check_secrets(rows_of(secrets.scan(odd)), texts(odd))
    check_secrets(rows_of(secrets.scan(clashing)), texts(odd))
    assert secrets.scan(empty).count() == 0
    kept = rows_of(secrets.redact(odd))
    assert len(kept) == 11
    seven = next(r for r in kept if r["doc_id"] == 7)
    assert seven["text"] == 'Größe [SECRET]" é😀 [SECRET] [SECRET]' and seven["n_chars"] == len(seven["text"])


@pytest.mark.parametrize("text,kinds", [
    ("key Zx8Kq2LmN0pRtV5wYb7Cd9Ef here", ["random"]),
    ("id 123e4567-e89b-12d3-a456-426614174000 here", []),
    ("the-quick-brown-fox-jumps-over-2024 here", []),
    ("internationalization-and-localization", []),
    ("sum D41D8CD98F00B204E9800998ECF8427E here", []),
    ("secret=token:abcdefghi", []),
    ("TOKEN: abcdef and PASSWD='x1x1x1x1'", ["assign", "assign"]),
    ("key QxZkPwVbNmLsRtYcJhGf here", ["random"]),  # letters only
    ("key QxZkPwVbNmLsRtYcJh1234 here", ["random"]),  # letters and a number are no identifier where the letters do not compress
    ("anticonstitutionnellement Rechtsschutzversicherungsgesellschaften HTTPServerRequestHandlerFactory", []),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", []),
    ("connection-pool-size-2048 org/apache/commons/lang3 ----------------------", []),
])
def test_secret_kinds(text, kinds):
    assert [secrets.KINDS[k] for _, k, _ in secrets.all_spans(text)] == kinds


def brute_random(text):
    """(start, end) of random runs, each held against all base spans, by the ratio alone."""
    encode, base, spans = tokens.rank_encoding(tokens.BYTE_RANKS).encode_ordinary, brute_secrets(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
        run = m[0]
        if any(a <= m.start() and m.end() <= b for a, _, b in base) or not re.search("[A-Za-z]", run):
            continue
        if len(run) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-fA-F]+", run) or re.fullmatch("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
            continue
        if len(run) / len(encode(run)) <= (2.0 if re.search("[0-9]", run) else 1.9):
            spans.append(m.span())
    return spans


def test_secrets_random_is_the_brute_version(spark, sf_dir, documents):
    """The random kind of every text of the table."""
    # The table's own secrets are all of the base kinds, so keys without a name are put into half the texts.
    keyed = documents.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" "), F.base64(F.unhex(F.md5(F.col("doc_id").cast("string")))), F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    want = {doc_id: [f"random:{a}:{b}" for a, b in brute_random(text)] for doc_id, text in texts(keyed)}
    found = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("random")] for r in rows_of(secrets.scan(keyed))}
    assert found == want and sum(map(len, want.values())) > 0.4 * len(want)


@pytest.mark.parametrize("alphabet,least", [("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.98), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.98), ("abcdefghijklmnopqrstuvwxyz", 0.9), ("0123456789abcdefghijklmnopqrstuvwxyz", 0.97)])
def test_secrets_random_recall(alphabet, least):
    draw = np.random.default_rng(9)
    runs = ["".join(draw.choice(list(alphabet), n)) for n in (20, 24, 32, 44) for _ in range(200)]
    assert np.mean([secrets.is_random(r) for r in runs]) >= least


def test_secrets_in_one_long_text():
    """Many spans in one text take time in proportion."""
    text = "token=abcdef1234 Zx8Kq2LmN0pRtV5wYb7Cd9Ef " * 20_000
    assert [sum(k == x for _, k, _ in secrets.all_spans(text)) for x in (0, 3)] == [20_000, 20_000]


def check_media(found, docs):
    def payload(text):
        b = text.encode()
        return b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))

    want = sorted((i is not None, i or 0, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, t in docs for p in [payload(t)])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == want
    seen = {}
    for r in found:
        assert r["media_bytes"] > r["payload_bytes"]
        assert seen.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_media(spark, sf_dir, documents):
    check_media(rows_of(catalogue.op4_media_columns(spark, sf_dir)), texts(documents))


def brute_pcm(tag, payload):
    """Samples of a payload at the target rate, one by one."""
    if tag == media.ADPCM:
        pcm = [v for k in range(0, len(payload), 576) for v in scalar_adpcm(payload[k : k + 576])]
    else:
        pcm = [int((media.MULAW_PCM if tag == media.MULAW else media.ALAW_PCM)[b]) for b in payload]
    rate, target = media.RATES[tag], media.TARGET_RATE
    out, k = [], 0
    while k * rate < len(pcm) * target:
        at, part = divmod(k * rate, target)
        out.append(pcm[at] + (pcm[min(at + 1, len(pcm) - 1)] - pcm[at]) * part // target)
        k += 1
    return np.array(out, "<i2").tobytes()


def test_media_odd(odd, clashing, empty):
    check_media(rows_of(media.media_columns(odd)), texts(odd))
    assert media.media_columns(empty).count() == 0
    texts_of = {i: t for i, t in texts(odd) if i is not None and len(t) < 1000}
    for tag in (None, media.MULAW, media.ALAW, media.ADPCM):
        found = rows_of(media.media_columns(clashing, tag, with_pcm=True))
        check_media(found, texts(odd))
        assert {r["format"] for r in found} <= ({media.NAMES[tag]} if tag else set(media.NAMES.values()))
        for r in found:
            kind, rate, pcm = media.wav_payload(bytes(r["pcm"]))
            assert (kind, rate) == (media.PCM, media.TARGET_RATE) and f"pcm_crc32={zlib.crc32(pcm)};" in r["feature"] and f"pcm_samples={len(pcm) // 2};" in r["feature"]
            if r["doc_id"] in texts_of:
                b = texts_of[r["doc_id"]].encode()
                of = next(t for t, n in media.NAMES.items() if n == r["format"])
                assert pcm == brute_pcm(of, b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b)))


def test_media_formats_are_all_used(spark, sf_dir):
    found = rows_of(catalogue.op4_media_columns(spark, sf_dir).groupBy("format").count())
    assert {r["format"] for r in found} == set(media.NAMES.values()) and all(r["count"] > 10 for r in found)


def test_media_is_held_in_small_pieces(spark, monkeypatch):
    """Stored files come in small row groups, workers get few rows at once, and the session stays as it was."""
    key, batches = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext.accumulator(0)
    cut = media.slices

    def counted(found, *args):
        for batch in found:
            batches.add(batch.num_rows > 2048)
            yield from cut([batch], *args)

    monkeypatch.setattr(media, "slices", counted)
    rng = np.random.default_rng(11)
    rows = [(i, rng.bytes(8000 if i < 600 else 200).hex()) for i in range(5000)]
    before = spark.conf.get(key, None)
    stored = media.store(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    decoded = media.decode(stored)
    found = media.with_features(decoded)
    assert spark.conf.get(key, None) == before and batches.value == 0
    for table in (stored, decoded):
        for file in glob.glob(f"{table.staged_path.removeprefix('file://')}/*.parquet"):
            seen = pq.ParquetFile(file).metadata
            assert max(seen.row_group(k).column(seen.num_columns - 1).total_compressed_size for k in range(seen.num_row_groups)) < 3 << 20
    check_media(rows_of(found), rows)
    with media.small_pieces(spark):
        assert spark.conf.get(key) == "2048"
        spark.conf.set(key, 7)
        with media.small_pieces(spark):
            assert spark.conf.get(key) == "7"
    assert spark.conf.get(key, None) == before


def test_media_decodes_by_the_file(spark):
    """Files of other makers: the tag and rate in the header decide, a null file gives nulls."""
    files = [(1, 2, media.wav(b"\x00\x80", media.MULAW, 16_000)), (2, 2, media.wav(b"\x00\x80", media.ALAW, 8000)), (3, 0, None)]
    found = {r["doc_id"]: r for r in rows_of(media.with_features(media.decode(spark.createDataFrame(files, "doc_id long, n_bytes long, media binary")), with_pcm=True))}
    assert np.frombuffer(media.wav_payload(bytes(found[1]["pcm"]))[2], "<i2").tolist() == [-32124]
    assert np.frombuffer(media.wav_payload(bytes(found[2]["pcm"]))[2], "<i2").tolist() == [int(media.ALAW_PCM[0]), int(media.ALAW_PCM[128])]
    assert found[3]["feature"] is None and found[3]["payload_bytes"] is None


def scalar_adpcm(block):
    value = int.from_bytes(bytes(block[:2]), "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                if code & bit:
                    change += step >> shift
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_is_the_scalar_decoder():
    data = np.random.default_rng(4).integers(0, 256, (5, 64)).astype(np.uint8)
    assert media.decode_adpcm(data).tolist() == [scalar_adpcm(block) for block in data.tolist()]


def test_g711_tables():
    mu, a = media.MULAW_PCM.astype(int), media.ALAW_PCM.astype(int)
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all()


def test_resampling_stays_inside_a_payload():
    out, edges = media.resample(np.array([0, 10, 100, 200, 300], np.int16), np.array([0, 2, 2, 5]), 4000, 8000)
    assert out.tolist() == [0, 5, 10, 10, 100, 150, 200, 250, 300, 300] and edges.tolist() == [0, 4, 4, 10]
    out, edges = media.resample(np.array([0, 10, 20, 30, 7], np.int16), np.array([0, 4, 5]), 16_000, 8000)
    assert out.tolist() == [0, 20, 7] and edges.tolist() == [0, 2, 3]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(ids, fps):
    """The smallest id reachable from each position."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark, sf_dir, documents):
    docs = texts(documents)
    fps = [brute_fingerprint(t) for _, t in docs]
    want = sorted(zip([i for i, _ in docs], [f"{f:016x}" for f in fps], brute_components([i for i, _ in docs], fps), strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(catalogue.op8_simhash(spark, sf_dir))) == want


def test_simhash_odd(odd, clashing, empty):
    docs = texts(odd)
    fps = [brute_fingerprint(t) for _, t in docs]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(zip([i for i, _ in docs], fps, brute_components([i for i, _ in docs], fps), strict=True), key=order)
    for table in (odd, clashing):
        got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows_of(simhash.near_duplicates(table))]
        assert sorted(got, key=order) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
    kept = sorted((r["doc_id"] for r in rows_of(simhash.one_of_each(odd))), key=lambda x: (x is not None, x))
    assert kept == [1, 3, 5, 6, 7, 8]


@pytest.mark.parametrize("bucket_rows", [8192, 6])
def test_simhash_links_in_crowded_buckets(spark, bucket_rows):
    draw = np.random.default_rng(8)
    fps = set()
    for centre in draw.integers(0, 1 << 62, 3).tolist():
        for _ in range(60):
            fps.add(centre ^ sum(1 << int(b) for b in draw.choice(24, draw.integers(0, 5), replace=False)))
    fps = sorted(fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in rows_of(simhash.components(simhash.links(table, bucket_rows=bucket_rows)))}
    groups = {}
    for i, x in zip(brute_components(list(range(len(fps))), fps), fps, strict=True):
        groups.setdefault(i, []).append(x)
    for members in groups.values():
        signed = [x - (1 << 64) if x >> 63 else x for x in members]
        assert {found.get(x, x) for x in signed} == {min(signed)}


@pytest.mark.parametrize("tile", [4, 64, 256])
def test_simhash_tiles_are_the_brute_version(documents, tile):
    """Every link inside the buckets of the table's own fingerprints comes from a tile pair, and far counts are skipped."""
    fps = np.unique(np.array([brute_fingerprint(t) for _, t in texts(documents)], np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for buckets in (np.zeros(len(fps), np.int64), (fps >> np.uint64(58)).astype(np.int64), np.arange(len(fps)) // 3):
        order = np.argsort(buckets, kind="stable")
        values = fps[order]
        a, b, compared = simhash.bucket_links(values, buckets[order], 2, tile)
        forest = simhash.Forest(len(fps))
        forest.join(np.searchsorted(fps, a), np.searchsorted(fps, b))
        x, y = np.nonzero(near & (buckets[:, None] == buckets[None, :]))
        want = simhash.Forest(len(fps))
        want.join(x, y)
        # What else is joined is linked too, in another bucket of the same tile.
        every = simhash.Forest(len(fps))
        every.join(*np.nonzero(near))
        assert (forest.least[x] == forest.least[y]).all() and (every.least[forest.least] == every.least).all()
        tiles = -(-len(fps) // tile)
        assert 0 < compared and (buckets.any() or tile > 4 or compared < 0.8 * tiles * (tiles + 1) / 2)
    assert simhash.bucket_links(fps[:0], np.zeros(0, np.int64), 2)[2] == 0


def test_simhash_links_between_sides():
    draw = np.random.default_rng(3)
    fps = np.unique(draw.integers(0, 1 << 10, 300).astype(np.uint64))
    left, right = fps[::2], fps[1::2]
    a, b = simhash.spanning_links(left, right, 2, 16)
    got, want = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    got.join(np.searchsorted(fps, a), np.searchsorted(fps, b))
    x, y = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= 2)
    want.join(2 * x, 2 * y + 1)
    assert (got.least == want.least).all()


def test_one_of_each_with_clashing_columns(odd, clashing):
    for table in (odd, clashing):
        kept = simhash.one_of_each(table)
        assert kept.columns == table.columns
        assert sorted((r["doc_id"] for r in rows_of(kept)), key=lambda x: (x is not None, x)) == [1, 3, 5, 6, 7, 8]
        redacted = secrets.redact(table)
        assert redacted.columns == table.columns and redacted.count() == table.count()


def test_components_by_shuffled_joins(spark, monkeypatch):
    """The way beyond the size that is broadcast, on a hub with many links."""
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1000) for k in range(0, 400, 2)] + [(5000, 5001)]
    found = {r["node"]: r["root"] for r in rows_of(simhash.components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {x: 0 for e in edges[:-1] for x in e} | {5000: 5000, 5001: 5000}


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)]
    found = {r["node"]: r["root"] for r in rows_of(simhash.components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def brute_license(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", lower)
    hits = [(r.priority, n, r.label, m.start(), m.end(), r.weight) for n, r in enumerate(licenses.rules()) if r.keyword in flat for m in regex.finditer(licenses.bounded(r.pattern), flat)]

    def beaten(h):
        for g in hits:
            nested = g[3] <= h[3] and g[4] >= h[4] or h[3] <= g[3] and h[4] >= g[4]
            size = (g[4] - g[3]) - (h[4] - h[3])
            if nested and (g[0] < h[0] or g[0] == h[0] and (size > 0 or size == 0 and g[1] < h[1])):
                return True
        return False

    kept = [h for h in hits if not beaten(h)]
    doubt = 0.5 if labels else 1.0
    for h in kept:
        doubt *= 1 - h[5]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[2] for h in kept})), round(1 - doubt, 9)


def check_license(found, docs):
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted(((i, *brute_license(t)) for i, t in docs), key=order)
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in found), key=order)
    assert got == want


def test_license(spark, sf_dir, documents):
    check_license(rows_of(catalogue.op9_license_scan(spark, sf_dir)), texts(documents))


LICENSES = [
    "CC BY cc-by CC BY 4.0, all rights reserved. All Rights  Reserved!",
    "Licensed under the Apache License, Version 2.0.\nSee https://www.apache.org/licenses/LICENSE-2.0 for more",
    "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.",
    "Creative Commons Attribution-ShareAlike 3.0 https://creativecommons.org/licenses/by-sa/3.0/ CC BY-NC 4.0 cc0",
    "© 2020 The Größe GmbH. Copyright (c) 2019. No part of this book may be reproduced",
    "licensed under some strange terms of our own. in the public domain. Permission is hereby granted, free of charge, to any person obtaining a copy",
    "cc by " * 300 + "mit license " * 50,
    "some rights\nreserved, Creative\nCommons Attribution 4.0, with no Invariant\r\n  Sections, no Front-Cover Texts, and no Back-Cover Texts; in the public\ndomain, cc\nby 4.0, MIT\tno attribution",
    "\u0130n the PUBLIC DOMAIN, \u212aelvin MIT L\u0130CENSE, MIT LICENSE, \u00c9MIT LICENSE",
    "copyright (c) 2020 " * 700,
]


def sample(nodes, most):
    """A text that the parsed pattern matches, with as few or as many of what is optional."""
    out = ""
    for kind, value in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            first = str(value[0][0]), value[0][1]
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "NEGATE": lambda v: "x", "CATEGORY": lambda v: "1"}[first[0]](first[1])
        elif kind == "ANY":
            out += "x"
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            out += sample(value[2], most) * (min(value[1], 3) if most else value[0])
        elif kind == "SUBPATTERN":
            out += sample(value[3], most)
        elif kind == "BRANCH":
            out += sample(value[1][-1 if most else 0], most)
    return out


def test_license_every_rule_is_reached(spark):
    """A sample of every rule is detected, in one line and with a line end for every space."""
    found, want = [], []
    for n, rule in enumerate(licenses.rules()):
        for most in (False, True):
            text = sample(licenses.parser.parse(rule.pattern), most)
            assert re.search(rule.pattern, text, re.A) and rule.keyword in text, rule
            found += [(len(found), text), (len(found) + 1, text.replace(" ", "\r\n"))]
            want += [n, n]
    scanned = {r["doc_id"]: r for r in rows_of(licenses.scan(spark.createDataFrame(found, "doc_id long, text string")))}
    check_license(list(scanned.values()), found)
    for k in range(0, len(found), 2):
        assert scanned[k]["labels"] and scanned[k]["labels"] == scanned[k + 1]["labels"] and scanned[k]["detections"] == scanned[k + 1]["detections"], found[k]
    assert sum(any(d["number"] == n for d in scanned[k]["detections"]) for k, n in enumerate(want)) > 0.9 * len(want)


def test_license_cases(spark, odd, clashing, empty):
    docs = list(enumerate(LICENSES))
    found = rows_of(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    check_license(found, docs)
    labels = {r["doc_id"]: set(r["labels"].split(",")) for r in found}
    assert {"reserved", "cc-by-4.0", "gfdl", "public-domain", "mit-0"} <= labels[8]
    assert labels[1] == {"apache-2.0"} and {"mit", "gpl-3.0-or-later"} <= labels[2] and {"gpl", "gpl-3.0", "mit"} <= labels[3] and {"cc-by-sa-3.0", "cc-by-nc-4.0"} <= labels[4]
    check_license(rows_of(licenses.scan(odd)), texts(odd))
    check_license(rows_of(licenses.scan(clashing)), texts(odd))
    assert licenses.scan(empty).count() == 0


def test_license_address_alone_passes_the_gate(spark):
    docs = [(1, "see eupl.eu for it"), (2, "see https://eupl.eu/1.2/en/ for it"), (3, "see nothing")]
    found = rows_of(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    check_license(found, docs)
    assert {r["doc_id"]: r["labels"] for r in found} == {1: "eupl-1.2", 2: "eupl-1.2", 3: ""}


def test_license_rules_are_hundreds():
    table = licenses.rules()
    assert len(table) > 200 and all(r.keyword == r.keyword.lower() and re.compile(r.pattern) for r in table)


def test_license_plan_is_native(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def check_warc(found, pages):
    want, first = [], {}
    for page_id, _, html in pages:
        p = (html or "").encode()
        if page_id is not None:
            first[p] = min(first.get(p, page_id), page_id)
    for page_id, _, html in pages:
        p = (html or "").encode()
        revisit = p in first and first[p] != page_id
        want.append((page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None))
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=order) == sorted(want, key=order)
    keys = [warc._order(r) for r in sorted(found, key=lambda r: (r["range"], r["position"]))]
    assert keys == sorted(keys) and len({(r["range"], r["position"]) for r in found}) == len(found)
    urls = {}
    for page_id, url, _ in pages:
        urls.setdefault(page_id, set()).add(warc.url_key(url and warc.target_uri(url)))
    assert all(r["urlkey"] in urls[r["page_id"]] for r in found if r["page_id"] is not None)


def test_warc(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    check_warc(rows_of(catalogue.warc_histories(spark, sf_dir)), pages)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_with_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    found = catalogue.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=order) == sorted(cursor.fetchall(), key=order)


def test_warc_odd(spark):
    same = "<p>same</p>"
    pages = [(3, "http://a.example.com/x", same), (1, "http://a.example.com/x", same), (2, "https://www.B.example.com:8080/?q=é", same), (2, "https://www.B.example.com:8080/?q=é", same), (4, None, None), (5, "not a url\r\nX: y", ""), (None, "http://a.example.com/", same), (None, None, "alone"), (7, "http://[bad", "é" * 100_000), (9, "", "a\r\n\r\nb")]
    pages += [(100 + k, "http://hot.example.com/", f"page {k}") for k in range(200)]
    for extra in ((), ("digest", "first", "range", "archive", "data", "run", "salt", "parts", "n")):
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        for name in extra:
            df = df.withColumn(name, df["url"])
        archives = warc.write_archives(df, archive_bytes=2000)
        for fan_in in (2, 64):
            check_warc(rows_of(warc.merge_runs(warc.capture_runs(archives, fan_in), 20, fan_in)), pages)
    assert warc.capture_histories(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_of_one_payload(spark):
    """A payload that all pages share is dealt to many tasks, and equal rows stay rows of their own."""
    pages = [(k % 3000, f"http://h.example.com/{k % 7}", "same" if k % 10 else f"own {k}") for k in range(6000)] + [(None, "http://n.example.com/", "same")] * 500
    found = rows_of(warc.merge_runs(warc.capture_runs(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), archive_bytes=20_000)), 500, 3))
    check_warc(found, pages)
    sizes = np.bincount([r["range"] for r in found])
    assert sizes.max() < 2000


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    draw = np.random.default_rng(k)
    runs = [sorted(draw.integers(0, 30, draw.integers(0, 20)).tolist()) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)
