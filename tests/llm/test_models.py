"""Language ID, quality, decontamination and the pipeline: brute force, recall and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weir.llm import catalogue, common, decontaminate, langid, packing, quality


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Language ID


def brute_languages(rows):
    """identify() in one process, row by row, over (key, text, declared, address)."""
    names = [*langid.LANGUAGES, langid.UNKNOWN]

    def grams(text):
        x = [int(langid._LETTERS[b]) for b in (text or "").encode()]
        padded = [32, *x, 32]
        for k, c in enumerate(x):
            if c != 32:
                yield ((padded[k] << 16 | c << 8 | padded[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 32 - langid.BITS

    counts = {x: np.zeros(1 << langid.BITS) for x in langid.LANGUAGES}
    for _, text, declared, _ in rows:
        if declared in counts:
            for g in grams(text):
                counts[declared][g] += 1
    logs = {x: np.log((c + 0.5) / (c + 0.5).sum()).astype(np.float32).astype(float) for x, c in counts.items()}
    logs[langid.UNKNOWN] = np.full(1 << langid.BITS, np.float32(-math.log(1 << langid.BITS)).astype(float))
    read = []
    for key, text, declared, address in rows:
        g = list(grams(text))
        scores = [sum(logs[x][k] for k in g) * (min(len(g), langid.INDEPENDENT) / max(len(g), 1)) for x in names]
        best = names[int(np.argmax(scores))] if g else langid.UNKNOWN
        host = (address or "").lower().split("//")[-1].split("/")[0]
        said = None if not declared else declared if declared in langid.LANGUAGES else "other"
        labels = host.split(".")
        registered = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in langid.REGISTRIES else 2
        read.append((key, scores, best, said, host, ".".join(labels[-registered:]), labels[-1] if "." in host else ""))
    n = {x: sum(r[2] == x for r in read) for x in names}
    overall = {x: (n[x] + 1) / (len(read) + len(names)) for x in names}
    overall[langid.UNKNOWN] = max(overall[langid.UNKNOWN], langid.UNKNOWN_SHARE)

    def share(level, value, x, parent):
        some = [r for r in read if r[level] == value]
        return (sum(r[2] == x for r in some) + langid.STRENGTH * parent) / (len(some) + langid.STRENGTH)

    out = {}
    for key, scores, best, said, host, domain, suffix in read:
        total = []
        for x, s in zip(names, scores, strict=True):
            country = langid.COUNTRY.get(suffix)
            base = overall[x] if country is None else 0.5 * overall[x] + 0.5 * (country == x)
            prior = share(4, host, x, share(5, domain, x, share(6, suffix, x, base)))
            weights = {d: sum(r[2] == x and r[3] == d for r in read) + (5.0 if d == x else 1.0) for d in [*langid.LANGUAGES, "other"]}
            total.append(s + math.log(prior) + (math.log(weights[said] / sum(weights.values())) if said else 0))
        top = max(total)
        out[key] = names[total.index(top)], 1 / sum(math.exp(t - top) for t in total), best
    return out


def test_language_is_the_brute_version(spark, sf_dir, documents):
    sample = documents.where("doc_id < 60")
    rows = [(r["doc_id"], r["text"], r["lang"], ("http://a.%s.de/x" % r["source"]) if r["doc_id"] % 3 else r["source"]) for r in sample.collect()]
    rows += [(1000, None, "de", "b.src1.de"), (1001, "", None, None), (1002, "12 + 34", None, "x.fr"), (1003, "the that this", "xx", "src2"), (1004, "de la que", None, "www.q.es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, address string")
    found = {r["doc_id"]: r for r in rows_of(langid.identify(df, ["doc_id"], F.col("lang"), F.col("address")))}
    want = brute_languages(rows)
    assert set(found) == set(want)
    for key, (language, posterior, text_language) in want.items():
        assert (found[key]["language"], found[key]["text_language"]) == (language, text_language), key
        assert found[key]["posterior"] == pytest.approx(posterior, abs=1e-4)


def check_languages(found, rows, key):
    want = brute_languages(rows)
    got = {r[key]: r for r in found}
    assert set(got) == set(want) and len(found) == len(rows)
    for k, (language, posterior, text_language) in want.items():
        assert (got[k]["language"], got[k]["text_language"]) == (language, text_language), k
        assert got[k]["posterior"] == pytest.approx(posterior, abs=1e-4)
        assert got[k]["accepted"] == (language != langid.UNKNOWN and got[k]["posterior"] >= langid.LEAST)


def test_language_query_is_the_brute_version(spark, sf_dir, documents):
    """The query over its whole table."""
    check_languages(rows_of(catalogue.op1_language_id(spark, sf_dir)), [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()], "doc_id")


def test_language_of_pages_is_the_brute_version(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        html = r["html"] or ""
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html, re.I)
        text = re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style)\b.*?</\1\s*>", " ", html, flags=re.I | re.S))
        rows.append((r["page_id"], text, said and said[1].lower(), r["url"]))
    found = rows_of(catalogue.language_id_pages(spark, sf_dir))
    check_languages(found, rows, "page_id")
    assert sum(r["language"] == d for r, (_, _, d, _) in zip(sorted(found, key=lambda r: r["page_id"]), sorted(rows), strict=True) if d) > 0.9 * len(rows)


def test_language_domains(spark):
    """A registered name, not the registry it stands under."""
    hosts = {"a.b.co.uk": "b.co.uk", "b.co.uk": "b.co.uk", "co.uk": "co.uk", "www.x.com": "x.com", "x.com": "x.com", "a.x.com.de": "x.com.de", "co.com": "co.com", "localhost": "localhost", "": "", "a.b.org.museum": "org.museum"}
    docs = spark.createDataFrame([(h, "") for h in hosts], "address string, text string")
    found = {r["address"]: r["domain"] for r in langid.evidence(docs, F.lit(None), F.col("address")).collect()}
    assert found == hosts


def test_language_held_out(documents):
    """Text alone names the language of documents whose declaration it was not taught."""
    hidden = documents.withColumn("declared", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = rows_of(langid.identify(hidden, ["doc_id", "lang"], F.col("declared"), F.col("source")).where("doc_id % 2 = 1"))
    assert sum(r["language"] == r["lang"] for r in found) >= 0.97 * len(found)


def test_language_odd(odd, clashing, empty):
    for table in (odd, clashing):
        found = rows_of(langid.identify(table, ["doc_id"], F.col("lang"), F.col("source")))
        assert len(found) == 11 and all(0 < r["posterior"] <= 1 for r in found)
        assert sorted(langid.accepted_rows(table, F.col("lang"), F.col("source")).columns) == sorted(table.columns)
    assert langid.identify(empty, ["doc_id"], F.col("lang"), F.col("source")).count() == 0
    assert langid.accepted_rows(empty, F.col("lang"), F.col("source")).count() == 0


def test_language_of_markup(spark):
    pages = spark.createDataFrame([(1, "http://x.example.fr/", '<!DOCTYPE html><html class=a lang="FR-ca"><script>var a="<p>"</script><p>le chat'), (2, None, None), (3, "http://y.de", "<p>ohne")], "page_id long, url string, html string")
    read = {r["page_id"]: r for r in rows_of(langid.of_pages(pages))}
    assert read[1]["declared"] == "FR" and read[1]["text"].split() == ["le", "chat"]
    found = {r["page_id"]: r for r in rows_of(langid.identify(langid.of_pages(pages), ["page_id"], F.col("declared"), F.col("url")))}
    assert found[1]["declared"] == "fr" and found[1]["language"] == "fr" and found[2]["declared"] is None and found[3]["host"] == "y.de"


def test_language_of_late_markup(spark):
    """The tag counts wherever it stands, and however long its attributes are."""
    tag = f'<HTML class="{"c " * 400}" LANG=de>'
    docs = spark.createDataFrame([(1, "x " * 50_000 + tag, None), (2, tag, "fr"), (3, "<html><p>" + "y " * 40_000 + '<html lang="es">', "fr"), (4, "none", "fr"), (5, None, "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["declared"] for r in langid.evidence(docs, F.col("lang"), F.lit("")).collect()} == {1: "de", 2: "de", 3: "es", 4: "fr", 5: "fr"}


# Quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in rows_of(catalogue.op6_quality(spark, sf))}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(found) == docs.count()
    for doc_id, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    labels = [(found[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in found]
    held = [(r["score"], q) for r, q in labels if r["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.95
    assert sum((s >= 0.3) == bool(q) for s, q in held) > 0.93 * len(held)


def test_quality_ignores_held_out_labels(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in rows_of(quality.scores(documents, x))} for x in (labels, flipped))
    assert all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_quality_odd(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (3, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for table in (odd, clashing):
        found = rows_of(quality.scores(table, labels))
        assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.scores(empty, labels).count() == 0
    assert len(rows_of(quality.scores(odd, labels.limit(0)))) == 11


def plain_statistics(text):
    """STATISTICS of one text, in plain Python."""
    data = text.encode()
    if not data:
        return [0.0] * len(quality.STATISTICS)
    n, lines, words = len(data), data.split(b"\n"), data.split()
    share = lambda members: sum(b in members for b in data) / n
    out = {
        "chars": math.log1p(n), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share(b"0123456789"), "symbols": share(b"#$%&*@^~<>{}[]\\_=+`"), "stops": share(b".,;:!?"), "bars": share(b"|"), "spaces": share(b" \t\n\r\x0b\x0c"), "high_bytes": share(range(128, 256)),
        "runs": sum(a == b for a, b in zip(data, data[1:], strict=False)) / n, "lines": math.log1p(len(lines)), "line_length": math.log1p(n / len(lines)), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "entropy": -sum(c / n * math.log2(c / n) for c in Counter(data).values()), "word_length": 0.0, "distinct_words": 0.0, "top_word": 0.0, "long_words": 0.0, "marked_words": 0.0,
    }
    if words:
        often = Counter(words)
        out |= {"word_length": math.log1p(sum(map(len, words)) / len(words)), "distinct_words": len(often) / len(words), "top_word": max(often.values()) / len(words), "long_words": sum(len(w) > 14 for w in words) / len(words), "marked_words": sum(w[-1] in b"#$%&*!@^~|" for w in words) / len(words)}
    return [out[k] for k in quality.STATISTICS]


def brute_quality(docs, labels):
    """Scores of (id, text) by one process: all rows' statistics, one least-squares solution, one isotonic fit."""
    stats = np.array([plain_statistics(t or "") for _, t in docs]).astype(np.float32).astype(float)
    mean, spread = stats.mean(axis=0), stats.std(axis=0)
    draw = np.random.default_rng(6)
    directions = draw.normal(size=(stats.shape[1], quality.COSINES)) / quality.WIDTH
    phases = draw.uniform(0, 2 * math.pi, quality.COSINES)
    z = np.clip((stats - mean) / np.where(spread > 1e-6, spread, 1), -8, 8)
    x = np.hstack([np.cos(z @ directions + phases) * math.sqrt(2 / quality.COSINES), np.ones((len(z), 1))])
    row = {i: k for k, (i, _) in enumerate(docs)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    marks = [(row[i], q, fold(i)) for i, q in labels if i in row and fold(i)]
    a = np.array([x[k] for k, _, f in marks if f != 1])
    y = np.array([float(q) for _, q, f in marks if f != 1])
    # Ridge as least squares with rows for the penalty; the constant is all but free.
    penalty = np.sqrt(np.append(np.full(quality.COSINES, quality.RIDGE * len(a)), 1e-9 * len(a)))
    weights = np.linalg.lstsq(np.vstack([a, np.diag(penalty)]), np.append(y, np.zeros(len(penalty))), rcond=None)[0]
    raw = x @ weights
    bins = {}
    for k, q, f in marks:
        if f == 1:
            bins.setdefault(min(max(int((raw[k] + 0.5) / 2 * quality.BINS), 0), quality.BINS - 1), []).append(q)
    order = sorted(bins)
    shares, sizes = [np.mean(bins[b]) for b in order], [len(bins[b]) for b in order]
    fit = [max(min(np.average(shares[i : j + 1], weights=sizes[i : j + 1]) for j in range(k, len(order))) for i in range(k + 1)) for k in range(len(order))]
    groups = {}
    for b, n, v in zip(order, sizes, fit, strict=True):
        groups.setdefault(round(v, 12), []).append(((b + 0.5) * 2 / quality.BINS - 0.5, n))
    points = [(-0.5, 0.0), *[(sum(c * n for c, n in g) / sum(n for _, n in g), v) for v, g in sorted(groups.items())], (1.5, 1.0)]
    return {i: float(np.interp(raw[k], *zip(*points, strict=True))) for i, k in row.items()}


def test_quality_is_the_brute_version(spark, sf_dir, documents):
    """The query's scores over its whole table."""
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    found = {r["doc_id"]: r["score"] for r in rows_of(catalogue.op6_quality(spark, sf_dir))}
    want = brute_quality(docs, labels)
    assert set(found) == set(want)
    apart = [abs(found[k] - want[k]) for k in want]
    assert max(apart) < 1e-3, sorted(apart)[-3:]


def test_features_approximate_the_gaussian_kernel():
    draw = np.random.default_rng(2)
    d, n = len(quality.STATISTICS), 4000
    model = quality.Model(np.zeros(d), np.ones(d), draw.normal(size=(d, n)) / quality.WIDTH, draw.uniform(0, 2 * np.pi, n))
    x = draw.normal(size=(20, d))
    wave = model.cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(wave @ wave.T - kernel).max() < 0.1


@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.1, 5)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_isotonic(pairs):
    values, weights = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    fit = quality.isotonic(values, weights)
    assert len(fit) == len(values) and (np.diff(fit) >= -1e-12).all()
    for k in range(len(values)):  # the min-max formula of the isotonic fit
        best = max(min(np.average(values[i : j + 1], weights=weights[i : j + 1]) for j in range(k, len(values))) for i in range(k + 1))
        assert fit[k] == pytest.approx(best)


# Decontamination


def edit_distance_inside(item, region):
    row = [0] * (len(region) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(region, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), st.binary(max_size=20).map(lambda b: bytes(x % 3 + 97 for x in b)))
@settings(max_examples=150, deadline=None)
def test_alignment(item, region):
    assert decontaminate.alignment(item, region)[0] == edit_distance_inside(item, region)


def altered(words, edits, draw):
    """The words with that many replaced, dropped or inserted."""
    out = list(words)
    for _ in range(edits):
        k, at = int(draw.integers(3)), int(draw.integers(len(out)))
        word = bytes(draw.integers(97, 123, 6).astype(np.uint8))
        out[at : at + (k != 1)] = [] if k == 0 else [word]
    return out


def test_recall_of_altered_items(spark, sf_dir, documents):
    """Items with a word in ten altered are found in documents again, and clean documents are left alone."""
    draw = np.random.default_rng(7)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"].encode()) for r in benchmark.collect()]
    prepared = decontaminate.prepare(items)
    clean = [r["text"].encode() for r in documents.collect() if not decontaminate.search([(r["text"] or "").encode()], prepared)]
    texts, want = [], []
    for k, (item_id, text) in enumerate(items * 4):
        words = decontaminate.words_of(text)
        host = clean[k % len(clean)].split()
        cut = len(host) // 2
        spoilt = altered(words, len(words) // 10, draw)
        if edit_distance_inside(b" ".join(words), b" ".join(spoilt)) <= decontaminate.EDITS * len(b" ".join(words)):
            want.append((len(texts), item_id))
        texts.append(b" ".join([*host[:cut], *spoilt, *host[cut:]]))
    found = {(row, prepared.ids[item]) for row, item, *_ in decontaminate.search(texts, prepared)}
    assert len(found & set(want)) >= 0.95 * len(want) and len(want) > 100
    assert len(found - set(want)) <= 0.02 * len(texts)


def misspelt(text, edits, draw):
    """The text with that many characters dropped, replaced or with one put before them."""
    at = set(draw.choice(len(text), edits, replace=False).tolist())
    letter = lambda: bytes([int(draw.integers(97, 123))])
    return b"".join((b"", letter(), letter() + text[i : i + 1])[int(draw.integers(3))] if i in at else text[i : i + 1] for i in range(len(text)))


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_of_misspelt_items(spark, sf_dir, documents, share):
    """Items with characters altered anywhere, up to the edit limit, are found in documents again."""
    draw = np.random.default_rng(11)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    prepared = decontaminate.prepare([(r["item_id"], r["text"].encode()) for r in benchmark])
    hosts = [b" ".join(decontaminate.words_of((r["text"] or "").encode()))[:300] for r in documents.collect()]
    texts, want = [], set()
    for k, text in enumerate(prepared.joined * 8):
        spoilt = b" ".join(decontaminate.words_of(misspelt(text, int(share * len(text)), draw)))
        if decontaminate.fewest_edits(text, spoilt, len(text)) <= decontaminate.EDITS * len(text):
            want.add((len(texts), k % len(prepared.joined)))
        texts.append(b" ".join([hosts[k % len(hosts)], spoilt, hosts[k % len(hosts)]]))
    found = {(row, item) for row, item, *_ in decontaminate.search(texts, prepared)}
    assert len(want) > 100 and len(found & want) >= 0.985 * len(want)


def test_short_items_are_the_brute_version():
    """Items too short for windows: every place within the edit limit, whichever word is altered, items listed twice included."""
    draw = np.random.default_rng(12)
    items = [b"seven brown foxes jumped over", b"a b c d e f", b"the quick grey cat sat on one mat", b"the quick grey cat sat on one mat"]
    prepared = decontaminate.prepare(list(enumerate(items)))
    texts = [b"some words before " + b" ".join(decontaminate.words_of(misspelt(items[k % 4], k % 7, draw))) + b" and after it" for k in range(280)]
    texts += [b"so " + t.replace(t.split()[k], b"xx", 1) + b" on" for t in items[:3] for k in range(5)]
    found = {(row, item) for row, item, *_ in decontaminate.search(texts, prepared)}
    assert found == {(row, k) for row, t in enumerate(texts) for k, i in enumerate(items) if edit_distance_inside(i, t) <= int(decontaminate.EDITS * len(i))}


@given(st.binary(min_size=1, max_size=90).map(lambda b: bytes(x % 3 + 97 for x in b)), st.binary(max_size=90).map(lambda b: bytes(x % 4 + 97 for x in b)), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_fewest_edits(item, region, most):
    got, want = decontaminate.fewest_edits(item, region, most), edit_distance_inside(item, region)
    assert got == want or min(got, want) > most


def test_leaks_are_the_brute_version(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = rows_of(catalogue.op7_decontamination(spark, sf_dir))
    items = [(r["item_id"], b" ".join(decontaminate.words_of(r["text"].encode()))) for r in benchmark.collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in items if t in b" ".join(decontaminate.words_of((r["text"] or "").encode()))}
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["edits"] > 0 and r["similarity"] >= 0.8 for r in found if (r["doc_id"], r["item_id"]) not in want)
    blocks = rows_of(decontaminate.leaks(documents, benchmark, item_bytes=2000))
    key = lambda r: (r["doc_id"], r["item_id"])
    assert sorted(blocks, key=key) == sorted(found, key=key)


def brute_leaks(spark, sf_dir, docs):
    """(id, item) of every item within the edit limit of any part of a text."""
    items = [(r["item_id"], b" ".join(decontaminate.words_of(r["text"].encode()))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for doc_id, text in docs:
        text = b" ".join(decontaminate.words_of((text or "").encode()))
        letters = Counter(text)
        for item_id, item in items:
            most = int(decontaminate.EDITS * len(item))
            # A part of the text cannot hold letters that the whole has not.
            if item in text or sum((Counter(item) - letters).values()) <= most and decontaminate.fewest_edits(item, text, most) <= most:
                want.add((doc_id, item_id))
    return want


def test_leaks_are_exhaustive_alignment(spark, sf_dir, documents):
    """The query against the edit distance of every item to every document: nothing else, and nine in ten at least."""
    want = brute_leaks(spark, sf_dir, [(r["doc_id"], r["text"]) for r in documents.collect()])
    found = {(r["doc_id"], r["item_id"]) for r in rows_of(catalogue.op7_decontamination(spark, sf_dir))}
    assert found <= want and len(found) >= 0.9 * len(want) and want


def test_items_of_few_words():
    """Items of one to four words are found word for word, wherever they stand, and not inside other words."""
    items = [b"Yes!", b"two words", b"two words", b"a b c d", b"... ?"]
    prepared = decontaminate.prepare(list(enumerate(items)))
    texts = [b"yes", b"yesterday two  WORDS, a b c d", b"two wordsmiths", b"", b"no two-words yes, yes"]
    assert [(row, prepared.ids[k], edits, first, n) for row, k, edits, first, n in decontaminate.search(texts, prepared)] == [(0, 0, 0, 0, 1), (1, 1, 0, 1, 2), (1, 2, 0, 1, 2), (1, 3, 0, 3, 4), (4, 0, 0, 3, 1), (4, 1, 0, 1, 2), (4, 2, 0, 1, 2)]


def test_items_that_repeat_themselves():
    """A key that stands at very many places of item and text does not multiply."""
    items = [b"ab " * 700, b"x" * 3000 + b" y z w v u", b"la la la la la la la la la la la la la la la la la la la la la la la la"]
    prepared = decontaminate.prepare(list(enumerate(items)))
    texts = [b"ab " * 9000, b"x" * 60_000 + b" y z w v u", b"other words " * 3000, b"so " + b"la " * 30 + b"end"]
    assert {(row, k) for row, k, *_ in decontaminate.search(texts, prepared)} == {(0, 0), (1, 1), (3, 2)}


def test_leaks_odd(spark, odd, clashing, empty):
    benchmark = spark.createDataFrame([(1, "two three four five six seven EIGHT!"), (1, "two three four five six seven EIGHT!"), (2, None), (None, "x y z a b c"), (3, ""), (4, "short one"), (5, "word the long and winding word the long")], "item_id long, text string")
    want = [(None, 1), (1, 1), (1, 1), (2, 1), (5, 5)]  # no text holds "short one"
    for table in (odd, clashing):
        found = rows_of(decontaminate.leaks(table, benchmark))
        assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=lambda x: (x[0] is not None, x[0] or 0)) == want
        kept = decontaminate.without_leaks(table, benchmark)
        assert kept.columns == table.columns and sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [3, 4, 6, 7, 8]
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0


# Pipeline


def brute_redacted(text):
    """The text with the base kinds and random runs replaced, overlapping ones together."""
    from tests.llm.test_digests import brute_random, brute_secrets

    spans = sorted([(a, b) for a, _, b in brute_secrets(text)] + brute_random(text))
    merged = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = "", 0
    for a, b in merged:
        out, at = out + text[at:a] + "[SECRET]", b
    return out + text[at:]


def test_pipeline_is_its_stages_by_hand(spark, sf_dir, documents):
    """Each stage's decision by the brute-force version of its operator, in one process."""
    from tests.llm.test_digests import brute_components, brute_fingerprint, check_packing

    docs = sorted(documents.collect(), key=lambda r: r["doc_id"])
    languages = brute_languages([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs])
    docs = [r for r in docs if languages[r["doc_id"]][0] != langid.UNKNOWN and languages[r["doc_id"]][1] >= langid.LEAST]
    ids = [r["doc_id"] for r in docs]
    first = dict(zip(ids, brute_components(ids, [brute_fingerprint(r["text"] or "") for r in docs]), strict=True))
    docs = [r for r in docs if first[r["doc_id"]] == r["doc_id"]]
    leaking = brute_leaks(spark, sf_dir, [(r["doc_id"], r["text"]) for r in docs])
    docs = [(r["doc_id"], brute_redacted(r["text"])) for r in docs if r["doc_id"] not in {d for d, _ in leaking}]
    assert leaking and len(docs) > 100
    check_packing(rows_of(corpus_pipeline.run(spark, sf_dir)), docs)


def test_pipeline_stages_on_odd_tables(spark, sf_dir, odd, clashing, empty):
    for table in (odd, clashing, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert packing.pack(docs).count() >= docs.count()


def test_pipeline_removes_what_it_staged(spark, sf_dir):
    """Of what the stages wrote, the last one's input alone is left."""
    before = common.written()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert common.written() <= before + 1
