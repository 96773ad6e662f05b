"""Language identification by Bayesian fusion of texts, declared markup, address suffixes and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import NO_ID, buffers, stash, text_key, without

BINS = 1 << 15
#: Bound on the labelled texts that the text model is fitted on.
SAMPLE = 4000
#: Overlapping trigrams are no independent evidence; their log-likelihood is scaled by this.
TEMPER = 1 / 3
#: Strength of the parent's prior in rows, and pseudo-count of the confusion tables.
STRENGTH, PSEUDO = 20.0, 1.0
CHUNK = 1 << 20
#: Languages in the evidence and in the labels are few; more labels than this are refused.
MOST_LANGUAGES = 200
UNKNOWN = "und"
#: Log of the odds against ``und``: only rows that look like no language at all are rejected.
DOUBT = 9.0
#: Letters as they are, A-Z lower-cased; digits, which say nothing of a language, are 0; all other ASCII is a space.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 if 48 <= b <= 57 else 32 for b in range(256)], np.uint32)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bins of the byte trigrams of a text with a space at both ends; those about a space or with digits are left out."""
    x = np.full(len(data) + 2, 32, np.uint32)
    x[1:-1] = _LOWER[data]
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(17))[(x[1:-1] != 32) & (x[:-2] != 0) & (x[1:-1] != 0) & (x[2:] != 0)].astype(np.int64)


@dataclass
class Model:
    """Log-probabilities by (bin, language); the last column is the uniform model of what is no language."""

    languages: list[str]
    table: np.ndarray


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit trigram models on at most ``sample`` labelled texts (text, lang), those of smallest hash in each language.

    Languages take turns until the sample is full, so each has an equal share of it or all its texts, however rare it
    is. Copies of a text count once, however many there are, with the least of their labels. Null labels are no
    labels. Without labels there are no languages.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    picked = _sampled(stash(rows.groupBy("h").agg(F.min("lang").alias("lang")), "hashes"), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                total.setdefault(lang, np.zeros(BINS, np.int64))
                for i in range(a, b, CHUNK):
                    total[lang] += np.bincount(trigrams(data[i : min(b, i + CHUNK)]), minlength=BINS)
        for lang, n in total.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(n[bins])], ["lang", "bin", "n"])

    if not picked:
        return Model([], np.full((BINS, 1), -np.log(BINS), np.float32))
    one = rows.join(F.broadcast(rows.sparkSession.createDataFrame(picked, "h long")), "h", "left_semi").groupBy("h").agg(F.min(F.struct("lang", "text")).alias("one")).select("one.lang", "one.text")
    counts = one.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(packed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the labels")
    table = np.full((BINS, len(packed) + 1), 0.5)
    for i, r in enumerate(packed):
        table[[x.bin for x in r.bins], i] += [x.n for x in r.bins]
    table[:, -1] = 1
    return Model([r.lang for r in packed], np.log(table / table.sum(axis=0)).astype(np.float32))


def _sampled(hashes: DataFrame, sample: int) -> list[tuple[int]]:
    """The hashes (of h, lang) that come first by their rank in their language, then by hash: at most ``sample``.

    Counts by length of the hash in bits bound what comes to the driver to about twice the sample.
    """
    bits = F.length(F.bin(F.col("h").bitwiseXOR(F.lit(-(2**63)))))
    sizes: dict[str, dict[int, int]] = {}
    for r in hashes.groupBy("lang", bits.alias("bits")).count().limit(64 * MOST_LANGUAGES + 1).collect():
        sizes.setdefault(r.lang, {})[r.bits] = r["count"]
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the labels")
    totals = sorted(sum(n.values()) for n in sizes.values())
    left, most = sample, 0
    for i, n in enumerate(totals):  # small languages whole, the others up to an equal share
        most = min(n, left // (len(totals) - i) + 1)
        left -= min(n, left // (len(totals) - i))
    near = F.lit(False)
    for lang, n in sizes.items():
        run, stop = 0, 64
        for b in sorted(n):
            run += n[b]
            if run >= most:
                stop = b
                break
        near = near | ((F.col("lang") == lang) & (bits <= stop))
    groups: dict[str, list[int]] = {}
    for r in hashes.filter(near).collect() if sizes else ():
        groups.setdefault(r.lang, []).append(r.h)
    ranked = sorted((rank, h) for found in groups.values() for rank, h in enumerate(sorted(found)))
    return [(h,) for _, h in ranked[:sample]]


def parent_of(host: Column) -> Column:
    """Where a host's prior comes from: its registered domain, or without dots its name less final digits."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(F.regexp_replace(host, "[0-9]+$", ""))


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """Evidence columns for documents: markup and addresses that the text itself holds; the source stands for the host."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        text.alias("text"),
        F.lower(F.regexp_extract(text, r"""(?i)<html[^>]{0,200}\blang=["']?([a-z]{2})\b""", 1)).alias("declared"),
        F.lower(F.regexp_extract(text, r"(?i)https?://[a-z0-9.-]+\.([a-z]{2})(?:[/:?#\s]|$)", 1)).alias("suffix"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
    )


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Evidence columns for web pages (page_id, url, html): tags are blanked for the text."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    country = F.regexp_extract(url, r"(?i)^[a-z]+://[^/]*\.([a-z]{2})(?:[:/?#]|$)", 1)
    folder = F.regexp_extract(url, r"(?i)^[a-z]+://[^/]+/([a-z]{2})(?:[/?#.]|$)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        plain.alias("text"),
        F.lower(F.regexp_extract(html, r"""(?i)<html[^>]{0,200}\blang=["']?([a-z]{2})\b""", 1)).alias("declared"),
        F.lower(F.when(folder != "", folder).otherwise(country)).alias("suffix"),
        F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/:?#]+)", 1)), F.lit("")).alias("host"),
    )


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """``id, one, two, language, confidence, rejected`` for each row of rows (id, text, declared, suffix, host).

    log posterior = TEMPER * text log-likelihood + log P(declared | language) + log P(suffix | language)
    + log prior(language | host). A first pass on texts alone labels every row; grouped counts of these labels give
    the two confusion tables and the priors: host smoothed by parent, parent by the global shares, STRENGTH rows
    each. ``und`` competes with the uniform trigram model and the least prior less DOUBT: rows that it wins, and those with
    no trigram at all (null, empty and texts without letters) unless markup or suffix name a language, are rejected. Without
    languages in the model nothing is rejected and language is null. ``one, two``: 128 bits that stand for the text.
    """
    spark, names = rows.sparkSession, model.languages
    k = len(names)
    keys = [c.alias(n) for c, n in zip(text_key(F.col("text")), ("one", "two"), strict=True)]
    if not k:
        return rows.select("id", *keys, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("rejected"))
    shared = spark.sparkContext.broadcast(model.table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(6))
            out = np.zeros((batch.num_rows, k + 1))
            n = np.zeros(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                for c in range(a, b, CHUNK):
                    t = trigrams(data[c : min(b, c + CHUNK)])
                    n[i] += len(t)
                    out[i] += table[t].sum(axis=0, dtype=np.float64)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, k + 1, dtype=np.int32), pa.array(out.reshape(-1)))
            best = np.where(n == 0, k, out.argmax(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(n), lists, pa.array(best)], ["id", "one", "two", "declared", "suffix", "host", "n", "logs", "best"])

    known = lambda c: F.when(F.col(c).isin(names), F.col(c)).when(F.coalesce(F.col(c), F.lit("")) == "", "").otherwise("?")
    given = rows.select("id", *keys, known("declared").alias("declared"), known("suffix").alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    first = stash(given.mapInArrow(score, "id long, one long, two long, declared string, suffix string, host string, n long, logs array<double>, best int"), "texts")

    counts = [F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in range(k)]
    whole = first.agg(*counts).first()
    shares = np.array([(whole[i] or 0) + 1 for i in range(k)])
    shares = shares / shares.sum()
    smooth = lambda own, up: [((F.col(f"{own}{i}") + STRENGTH * up(i)) / (F.expr("+".join(f"{own}{j}" for j in range(k))) + STRENGTH)) for i in range(k)]
    hosts = first.groupBy("host").agg(*counts).withColumn("parent", parent_of(F.col("host")))
    parents = hosts.groupBy("parent").agg(*(F.sum(f"n{i}").alias(f"p{i}") for i in range(k)))
    parents = parents.select("parent", *(c.alias(f"q{i}") for i, c in enumerate(smooth("p", lambda i: float(shares[i])))))
    priors = hosts.join(parents, "parent").select("host", F.array(*smooth("n", lambda i: F.col(f"q{i}"))).alias("prior"))
    priors = stash(priors, "priors")  # so that the join below can split a hot host

    def confusion(column: str) -> Column:
        """log P(seen | language) as a map from the value seen to an array by language; at most k + 2 values."""
        values = ["", "?", *names]
        seen = {r[0]: [r[1 + i] or 0 for i in range(k)] for r in first.groupBy(column).agg(*counts).collect()}
        grid = np.array([seen.get(v, [0] * k) for v in values]) + PSEUDO / len(values)
        # a value that names a language speaks for it even where texts were never seen with it
        grid += np.array([[PSEUDO if v == names[i] else 0 for i in range(k)] for v in values])
        logs = np.log(grid / grid.sum(axis=0))
        return F.create_map(*(x for v, row in zip(values, logs, strict=True) for x in (F.lit(v), F.array(*(F.lit(float(y)) for y in row)))))[F.col(column)]

    total = lambda i: F.col("logs")[i] * TEMPER + F.ln(F.col("prior")[i]) + F.col("d")[i] + F.col("s")[i]
    least = F.lit(float(np.log(shares.min())) - DOUBT)
    nothing = F.array_min("d") + F.array_min("s")
    unknown = F.when((F.col("n") == 0) & (F.col("declared").isin("", "?")) & (F.col("suffix").isin("", "?")), F.lit(1e9)).otherwise(F.col("logs")[k] * TEMPER + least + nothing)
    scored = first.join(priors, "host").withColumns({"d": confusion("declared"), "s": confusion("suffix")})
    scored = scored.withColumn("all", F.array(*(F.struct(total(i).alias("x"), F.lit(names[i]).alias("language")) for i in range(k)), F.struct(unknown.alias("x"), F.lit(UNKNOWN).alias("language"))))
    best = F.array_max("all")
    scored = scored.withColumn("top", best).withColumn("mass", F.aggregate("all", F.lit(0.0), lambda m, a: m + F.exp(a["x"] - F.col("top.x"))))
    return scored.select("id", "one", "two", F.col("top.language").alias("language"), (1 / F.col("mass")).alias("confidence"), (F.col("top.language") == UNKNOWN).alias("rejected"))


def known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows in which no language is found; columns stay as they are, whatever their names.

    docs: doc_id, text, lang, source and any others. The model is fitted on a bounded sample of the docs' own labels
    (lang), each language with its share of it. Null, empty and letterless texts go unless markup or suffix names a
    language; null ids, labels and sources are fine; repeated rows share one fate; without labels, or rows, nothing goes.
    """
    gone = identify(evidence_of_documents(docs), train(docs)).filter("rejected")
    return without(docs, gone.select(F.coalesce("id", F.lit(NO_ID)).alias("did"), "one", "two").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(evidence_of_documents(docs), train(docs))
    return found.select(F.col("id").alias("doc_id"), "language", F.round("confidence", 6).alias("confidence"), "rejected")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by models of the labelled documents."""
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = identify(evidence_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), model)
    return found.select(F.col("id").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "rejected")
