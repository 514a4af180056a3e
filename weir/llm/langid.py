"""Language identification by Bayesian fusion of text, declaration and address.

Three kinds of evidence are multiplied.  Text: hashed byte trigrams under one
multinomial a language, its counts summed over all rows by grouped aggregation,
and tempered, since neighbouring trigrams are not independent.  Declaration: the
markup's lang attribute or else a lang column, through a table of how often each
declaration goes with each text language.  Address: a prior of the host, smoothed
towards its domain, that towards its suffix, and that towards all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import flat_bytes, numbered, row_sums, slices, staged, without_rows

LANGUAGES = ("de", "en", "es", "fr")
#: Text in none of the languages: every trigram is as likely as any other.
UNKNOWN = "und"
BITS = 14
#: Trigrams of a text that count as independent, at most.
INDEPENDENT = 60
#: Share of an unknown language in the priors, and rows that a level's parent counts for.
UNKNOWN_SHARE = 0.01
STRENGTH = 20.0
#: Posterior from which a row is accepted.
LEAST = 0.5

# Languages of country-code suffixes; they count STRENGTH rows.
COUNTRY = {"de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}

# Labels under which country-code suffixes register names, as in example.co.uk.
REGISTRIES = ("ac", "asn", "co", "com", "edu", "gob", "gov", "gv", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch")

# Letters in lower case and bytes of other characters; all else separates words.
_LETTERS = np.array([(b | 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters and word edges, one a byte, and which of them count."""
    x = _LETTERS[flat].astype(np.uint32)
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    there = np.diff(offsets) > 0
    first[offsets[:-1][there]], last[offsets[1:][there] - 1] = True, True
    before, after = np.r_[x[:1], x[:-1]], np.r_[x[1:], x[-1:]]
    before[first], after[last] = 32, 32
    code = ((before << np.uint32(16) | x << np.uint32(8) | after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return code, x != 32


def markup_language(text: Column) -> Column:
    """The lang attribute of the first html tag that has one, wherever it stands; none: null or empty."""
    return F.when(F.contains(F.lower(text), F.lit("<html")), F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))


def evidence(docs: DataFrame, declared: Column, address: Column) -> DataFrame:
    """docs with declared (a language, "other" or null), host, domain and suffix."""
    markup = markup_language(F.col("text"))
    said = F.lower(F.coalesce(F.nullif(markup, F.lit("")), F.regexp_extract(declared.cast("string"), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)))
    host = F.lower(F.regexp_extract(F.coalesce(address.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return docs.withColumns({
        "declared": F.when(said.isin(*LANGUAGES), said).when(said != "", "other"),
        "host": host,
        "domain": F.regexp_extract(host, rf"([^.]+\.(?:(?:{'|'.join(REGISTRIES)})\.[a-z][a-z]|[^.]+)|[^.]*)$", 1),
        "suffix": F.when(F.contains(host, F.lit(".")), F.regexp_extract(host, r"([^.]+)$", 1)).otherwise(""),
    })


def _counted(rows: DataFrame) -> np.ndarray:
    """languages x codes trigram counts of the rows (text, declared), summed over partitions."""
    k, size = len(LANGUAGES), 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * size, np.int64)
        for batch in slices(batches, "text"):
            flat, offsets = flat_bytes(batch.column("text"))
            code, counts = trigrams(flat, offsets)
            language = np.array([LANGUAGES.index(x) for x in batch.column("declared").to_pylist()], np.uint32)
            total += np.bincount((code + np.repeat(language, np.diff(offsets)) * np.uint32(size))[counts], minlength=k * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    summed = rows.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()
    out = np.zeros(k * size)
    for cell, n in summed:  # as many as languages and codes at most
        out[cell] = n
    return out.reshape(k, size)


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """(languages + unknown) x codes log probabilities, add-half smoothed."""
    known = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
    return np.concatenate([known, np.full((1, counts.shape[1]), -math.log(counts.shape[1]))]).astype(np.float32)


def text_scores(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """n x (languages + unknown) tempered log likelihoods; zeros where a text has no letter."""
    code, counts = trigrams(flat, offsets)
    n = row_sums(counts.astype(np.int32), offsets)
    total = np.stack([row_sums(np.where(counts, row[code], np.float32(0)), offsets) for row in table], axis=1)
    return total * (np.minimum(n, INDEPENDENT) / np.maximum(n, 1))[:, None]


def _scored(rows: DataFrame, table: np.ndarray, keys: list[str]) -> DataFrame:
    """keys, evidence columns and a score column s_<language> each, with the best text language."""
    names = [*LANGUAGES, UNKNOWN]
    kept = [*keys, "declared", "host", "domain", "suffix"]
    shared = rows.sparkSession.sparkContext.broadcast(table)  # bounded by languages and codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = text_scores(*flat_bytes(batch.column("text")), shared.value)
            best = [names[k] if any_ else UNKNOWN for k, any_ in zip(scores.argmax(axis=1).tolist(), scores.any(axis=1).tolist(), strict=True)]
            arrays = [*[batch.column(c) for c in kept], pa.array(best, pa.string()), *[pa.array(scores[:, k]) for k in range(len(names))]]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "text_language", *[f"s_{x}" for x in names]])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema] + ["text_language string", *[f"s_{x} double" for x in names]]
    return rows.select(*kept, "text").mapInArrow(run, ", ".join(fields))


def host_priors(scored: DataFrame) -> DataFrame:
    """(host, domain, p_<language>...): the share of each text language, smoothed over domain, suffix and all rows."""
    names = [*LANGUAGES, UNKNOWN]
    counts = [F.sum((F.col("text_language") == x).cast("double")).alias(f"n_{x}") for x in names]
    again = [F.sum(f"n_{x}").alias(f"n_{x}") for x in names]
    hosts = scored.groupBy("host", "domain", "suffix").agg(*counts)
    domains = hosts.groupBy("domain", "suffix").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    whole = suffixes.agg(*again).first()
    seen = [float(whole[f"n_{x}"] or 0) for x in names]
    overall = [(n + 1) / (sum(seen) + len(names)) for n in seen]
    overall[-1] = max(overall[-1], UNKNOWN_SHARE)

    def smoothed(level: DataFrame, parent: dict[str, Column]) -> list[Column]:
        total = sum((F.col(f"n_{x}") for x in names), F.lit(0.0))
        return [((F.col(f"n_{x}") + STRENGTH * parent[x]) / (total + STRENGTH)).alias(f"p_{x}") for x in names]

    country = F.create_map(*[F.lit(v) for pair in COUNTRY.items() for v in pair])
    of_country = F.try_element_at(country, F.col("suffix"))
    base = {x: F.when(of_country.isNull(), F.lit(p)).otherwise(0.5 * p + 0.5 * (of_country == x).cast("double")) for x, p in zip(names, overall, strict=True)}
    suffixes = suffixes.select("suffix", *smoothed(suffixes, base))
    parents = {x: F.col(f"p_{x}") for x in names}
    domains = domains.join(suffixes, "suffix").select("domain", *smoothed(domains, parents))
    return hosts.join(domains, "domain").select("host", *smoothed(hosts, parents))


def identify(docs: DataFrame, keys: list[str], declared: Column | None = None, address: Column | None = None, least: float = LEAST) -> DataFrame:
    """keys, language, posterior, text_language, declared, host and accepted, for every row of docs (text and what the columns need).

    A row without letters rests on its declaration and address alone; without
    these too, on all rows' shares.  It is accepted where its language is known
    and its posterior at least `least`.  Null text counts as empty; null
    declarations and addresses give no evidence; very long texts are read whole;
    repeated rows are returned once each; other columns are not read; an empty
    table gives no rows.
    """
    names = [*LANGUAGES, UNKNOWN]
    declared = F.lit(None) if declared is None else declared
    address = F.lit(None) if address is None else address
    rows = evidence(docs, declared, address).select(*keys, F.col("text").cast("binary").alias("text"), "declared", "host", "domain", "suffix")
    taught = rows.where(F.col("declared").isin(*LANGUAGES)).select("text", "declared")
    scored = staged(_scored(rows, log_likelihoods(_counted(taught)), keys), "languages")

    # How often each text language is declared as what; a declaration is right far more often than not.
    pairs = {(r[0], r[1]): r[2] for r in scored.where("declared is not null").groupBy("text_language", "declared").count().collect()}
    said = [*LANGUAGES, "other"]
    declares = {}
    for x in names:
        weight = {d: pairs.get((x, d), 0) + (5.0 if d == x else 1.0) for d in said}
        declares |= {(x, d): math.log(w / sum(weight.values())) for d, w in weight.items()}

    # Written first, so that the rows of one large host can be dealt to several tasks.
    fused = scored.join(staged(host_priors(scored), "priors"), "host")
    for x in names:
        by = F.lit(0.0)
        for d in said:
            by = F.when(F.col("declared") == d, F.lit(declares[x, d])).otherwise(by)
        fused = fused.withColumn(f"l_{x}", F.col(f"s_{x}") + F.log(f"p_{x}") + by)
    top = F.greatest(*[F.col(f"l_{x}") for x in names])
    fused = fused.withColumn("top", top)
    total = sum((F.exp(F.col(f"l_{x}") - F.col("top")) for x in names), F.lit(0.0))
    language = F.coalesce(*[F.when(F.col(f"l_{x}") == F.col("top"), F.lit(x)) for x in names])
    out = fused.select(*keys, language.alias("language"), (1 / total).alias("posterior"), "text_language", "declared", "host", F.log(F.greatest(*[F.col(f"p_{x}") for x in names])).alias("log_host_prior"))
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= least))


def accepted_rows(docs: DataFrame, declared: Column | None = None, address: Column | None = None, least: float = LEAST) -> DataFrame:
    """docs without the rows that identify() does not accept; all their columns stay, whatever their names."""
    keyed, row = numbered(docs)
    return without_rows(keyed, row, identify(keyed, [row], declared, address, least).where(~F.col("accepted")).select(row))


def of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, declared, text): pages as rows for identify(), their text without scripts and tags."""
    html = F.coalesce("html", F.lit(""))
    declared = F.nullif(markup_language(html), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    return pages.select("page_id", "url", declared.alias("declared"), text.alias("text"))
