"""Quality rules: base rules on each text, then robust multivariate outliers by language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.llm.common import SPACED, attach, byte_table, free_name, gram_hashes, read_table, stored, text_bytes, word_batches

P = 4  # length of the statistic vector
SYMBOLS = b"#*$%&|<>"
#: A stratum with fewer different texts is judged by its language's estimate, a language by that of all; a table with
#: fewer in all is judged by the base rules alone.
LEAST = 100
BLOCK_ROWS = 4_000
#: Share of the language's own spread that each scatter estimate holds (the regularised form of the estimator), so that a
#: source of near copies alone doesn't get a scatter of nothing.
RHO = 0.1
SEGMENT = 50  # words of a segment in which different words are counted
TINY = 1e-4  # a statistic of less spread is numerically constant in a language: there it has the spread of all languages,
CONSTANT = 0.03  # and this one where it is constant in all of them


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dof) < q else (lo, mid)
    return hi


def _consistency(h: float) -> float:
    """Makes the covariance of the closest share h that of the whole, for normal data."""
    return h / _chi2_cdf(_chi2_quantile(h, P), P + 2)


# ---------------------------------------------------------------- statistics


def count_repeat_words(words: np.ndarray, n: int = 8) -> int:
    """Words in n-word windows that stand twice or more in the text."""
    grams = gram_hashes(words, n)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    d = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(d, at, 1)
    np.add.at(d, at + n, -1)
    return int((np.cumsum(d[:-1]) > 0).sum())


def _class(chars) -> np.ndarray:
    return ~byte_table(chars)


_SYMBOL, _UPPER = _class(SYMBOLS), _class(range(0x41, 0x5B))
_LETTER = _class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])  # a letter beyond ASCII counts at its first byte
_MARK = _class([b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_bytes", "n_seen", "n_different")


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text; n_seen are the words of whole segments (all words of a shorter text), n_different the words in them that are new in their segment."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in COUNTS}
    for lo, buf, starts, ends, hashes, first in word_batches(texts, SPACED):
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points begin at other bytes than 10xxxxxx
        lengths = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
        classes = {k: np.concatenate([[0], np.cumsum(t[buf])]) for k, t in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK))}
        at = 0
        for k in range(len(first) - 1):
            i, a, b = lo + k, first[k], first[k + 1]
            size, n = len(texts[i]), b - a
            out["n_words"][i], out["n_bytes"][i] = n, size
            out["word_chars"][i] = lengths[b] - lengths[a]
            for c, sums in classes.items():
                out[c][i] = sums[at + size] - sums[at]
            out["n_repeat_words"][i] = count_repeat_words(hashes[a:b])
            seen = n // SEGMENT * SEGMENT or n
            if seen:
                seg = np.sort(hashes[a : a + seen].reshape(-1, min(n, SEGMENT)), axis=1)
                out["n_seen"][i], out["n_different"][i] = seen, len(seg) + (seg[:, 1:] != seg[:, :-1]).sum()
            at += size + 1
            lines = [x for x in texts[i].split(b"\n") if x and x.strip(b" \t\r\x0b\x0c")]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def with_statistics(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns `keep` of docs, and a struct `name` of COUNTS, digest (of the text), base_failed, fine (key of language and source) and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column("text"))
            s = text_statistics(texts)
            digest = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
            counts = pa.StructArray.from_arrays([*(pa.array(s[k]) for k in COUNTS), pa.array(digest)], [*COUNTS, "digest"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), counts], [*keep, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    need = list(dict.fromkeys([*keep, "text", "lang", "source"]))
    langs = [c for c in ("lang", "source") if c not in keep]
    kinds += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in langs)
    keep = [*keep, *langs]
    rows = docs.select(*need).mapInArrow(run, f"{kinds}, `{name}` struct<{', '.join(f'{c}: bigint' for c in (*COUNTS, 'digest'))}>")
    q = lambda c: F.col(f"{name}.{c}")
    failed = (q("n_words") < 20) | (100 * q("n_repeat_words") > 30 * q("n_words"))
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    more = F.struct(*[q(c).alias(c) for c in (*COUNTS, "digest")], failed.alias("base_failed"), F.to_json(F.struct(lang.alias("l"), source.alias("s"))).alias("fine"), F.to_json(F.struct(lang.alias("lang"))).alias("lang"))
    return rows.withColumn(name, more).drop(*langs)


#: The ratios of the vector: counted and counted among; as many more of the latter are added at the language's own middle ratio.
RATIOS = (("word_chars", "n_words", 50), ("n_marks", "n_bytes", 400), ("n_upper", "n_letters", 300), ("n_different", "n_seen", 4 * SEGMENT))


def middles(good: DataFrame) -> tuple[DataFrame, list[float]]:
    """(lang, n, middle): median ratios of each language's rows, and those of all rows."""
    medians = F.array(*[F.percentile_approx(F.col(a) / F.greatest(F.col(b), F.lit(1)), 0.5, 10_000) for a, b, _ in RATIOS])
    whole = good.agg(medians.alias("m")).collect()[0]["m"]
    return good.groupBy("lang").agg(medians.alias("middle")), [v if v is not None else 1.0 for v in whole]


def vector(count, middle: Column) -> Column:
    """Logarithm of the mean word length, square roots of the shares of marks and of capitals, share of words new in their segment.

    Ratios of short texts are drawn to the language's middle, so that their spread doesn't come from length alone.
    """
    r = [(count(a) + more * F.get(middle, F.lit(i))) / (count(b) + float(more)) for i, (a, b, more) in enumerate(RATIOS)]
    return F.array(F.log(r[0]), F.sqrt(r[1]), F.sqrt(r[2]), r[3])


# ---------------------------------------------------------------- robust location and scatter


def _distances(x: np.ndarray, mu: np.ndarray, s: np.ndarray) -> np.ndarray:
    d = x - mu
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)


def fast_mcd(x: np.ndarray, target: np.ndarray, share: float = 0.75, starts: int = 12, seed: int = 7, best: int = 1) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best estimates (log determinant, location, scatter) of the share of rows whose scatter has the least determinant.

    Concentration steps begin at the coordinatewise medians and at small random subsets of the rows, taken in sorted order;
    after two steps the best three go on to the end. A scatter is (1 - RHO) of the subset's covariance, made
    consistent for normal data, and RHO of the diagonal `target`.
    """
    x = x[np.lexsort(x.T)]
    n, t = len(x), np.diag(target)
    h = max(min(n, P + 1), int(math.ceil(share * n)))
    factor = _consistency(share) if h < n else 1.0

    def fit(rows):
        return rows.mean(axis=0), (1 - RHO) * factor * np.cov(rows, rowvar=False, bias=True).reshape(P, P) + RHO * t

    def step(mu, s):
        return fit(x[np.argpartition(_distances(x, mu, s), h - 1)[:h]])

    rng = np.random.default_rng(seed)
    med = np.median(x, axis=0)
    begun = [(med, np.diag(np.square(np.median(np.abs(x - med), axis=0) * 1.4826)) + RHO * t)]
    begun += [fit(x[rng.choice(n, size=min(n, P + 1), replace=False)]) for _ in range(starts)]
    tried = []
    for mu, s in begun:
        for _ in range(2):
            mu, s = step(mu, s)
        tried.append((np.linalg.slogdet(s)[1], mu, s))
    tried.sort(key=lambda c: c[0])
    out = []
    for det, mu, s in tried[: max(3, best)]:
        for _ in range(50):
            mu, s = step(mu, s)
            new = np.linalg.slogdet(s)[1]
            if new >= det - 1e-9:
                break
            det = new
        out.append((np.linalg.slogdet(s)[1], mu, s))
    return sorted(out, key=lambda c: c[0])[:best]


def mahalanobis(x: str = "x", mu: str = "mu", prec: str = "prec") -> Column:
    d = [F.col(x)[i] - F.col(mu)[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col(prec)[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _strata(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fine, stratum) by which each language and source is judged, and (fine, stratum, target) of the rows that each estimate takes."""
    sizes = stored(vectors.groupBy("fine", "lang").agg(F.count("*").alias("n")), "quality-sizes")
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    total = sizes.agg(F.sum("n")).collect()[0][0] or 0
    level = sizes.join(by_lang.hint("merge"), "lang")
    level = level.withColumn("stratum", F.when(F.col("n") >= LEAST, F.col("fine")).when(F.col("n_lang") >= LEAST, F.concat(F.lit("lang "), "lang")).when(F.lit(total) >= LEAST, "all"))
    level = stored(level, "quality-levels")
    used = level.select("fine", "stratum").where("stratum is not null")

    # the spread of a language, from its quartiles
    def spread(c: str) -> Column:
        return F.array(*[(F.get(F.col(f"q{i}"), F.lit(1)) - F.get(F.col(f"q{i}"), F.lit(0))) / 1.349 for i in range(P)]).alias(c)

    quartiles = [F.percentile_approx(F.col("x")[i], [0.25, 0.75], 10_000).alias(f"q{i}") for i in range(P)]
    whole = vectors.agg(*quartiles).select(spread("whole")).collect()[0]["whole"]
    whole = [(v or 0.0) ** 2 if (v or 0.0) > TINY else CONSTANT**2 / RHO for v in whole]
    stand_in = [v if v == CONSTANT**2 / RHO else v / RHO for v in whole]  # without a spread of its own the target counts in full
    own = vectors.groupBy("lang").agg(*quartiles).select("lang", spread("own"))
    own = own.select("lang", F.array(*[F.when(F.col("own")[i] > TINY, F.pow(F.col("own")[i], 2)).otherwise(stand_in[i]) for i in range(P)]).alias("target"))
    parts = level.join(own.hint("merge"), "lang")
    takes = parts.where(F.col("n") >= LEAST).select("fine", F.col("fine").alias("stratum"), "target", "n")
    takes = takes.unionByName(parts.where((F.col("least") < LEAST) & (F.col("n_lang") >= LEAST)).select("fine", F.concat(F.lit("lang "), "lang").alias("stratum"), "target", "n"))
    if total >= LEAST and level.where(F.col("n_lang") < LEAST).limit(1).count():
        takes = takes.unionByName(level.select("fine", F.lit("all").alias("stratum"), F.array(*map(F.lit, whole)).alias("target"), "n"))
    blocks = takes.groupBy("stratum").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("blocks"))
    takes = takes.join(blocks.hint("merge"), "stratum").select("fine", "stratum", "target", "blocks")
    return used, stored(takes, "quality-takes")


_MODEL = "stratum string, blocks long, det double, mu array<double>, s array<double>, target array<double>"


def _inverted(models: DataFrame) -> DataFrame:
    """Covariances to scatters (regularised), determinants and precisions; a row for each model."""

    def run(batches):
        for pdf in batches:
            s = [(1 - RHO) * np.array(c).reshape(P, P) + RHO * np.diag(t) for c, t in zip(pdf["cov"], pdf["target"], strict=True)]
            yield pd.DataFrame({"stratum": pdf["stratum"], "mu": pdf["mu"], "target": pdf["target"], "det": [np.linalg.slogdet(m)[1] for m in s], "prec": [np.linalg.inv(m).ravel().tolist() for m in s]})

    return models.mapInPandas(run, "stratum string, mu array<double>, target array<double>, det double, prec array<double>")


def _moments(near: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Mean and covariance of the rows of each model, in the covariance the factor that makes it consistent."""
    xi = [F.col("x")[i] for i in range(P)]
    cov = F.array(*[F.covar_pop(xi[i], xi[j]) * factor for i in range(P) for j in range(P)])
    return near.groupBy(*by).agg(F.array(*[F.avg(v) for v in xi]).alias("mu"), cov.alias("cov"), F.first("target").alias("target"))


def estimate_strata(vectors: DataFrame, takes: DataFrame, share: float = 0.75, candidates: int = 3, steps: int = 2) -> DataFrame:
    """(stratum, mu, prec): regularised minimum-covariance-determinant estimates over all vectors that each stratum takes.

    Nested as for large data: each block of about BLOCK_ROWS vectors, dealt by hash, gives its best candidates. The best
    of a stratum's blocks take concentration steps over all its vectors; the one of least determinant is then
    reweighted: mean and covariance of all vectors within its 97.5 % ellipsoid.
    """
    rows = attach(vectors.select("fine", "digest", "x"), takes, "fine", "inner").drop("fine")
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks"))), "quality-rows")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = fast_mcd(np.array(pdf["x"].tolist(), dtype=float).reshape(-1, P), np.array(pdf["target"].iloc[0]), share, best=candidates)
        k = len(found)
        return pd.DataFrame({"stratum": [key[0]] * k, "blocks": [pdf["blocks"].iloc[0]] * k, "det": [d for d, _, _ in found], "mu": [m.tolist() for _, m, _ in found], "s": [s.ravel().tolist() for _, _, s in found], "target": [pdf["target"].iloc[0]] * k})

    each = stored(rows.groupBy("stratum", "block").applyInPandas(fit, _MODEL), "mcd-candidates")
    cov = F.array(*[(F.col("s")[i] - (RHO * F.col("target")[i // P] if i % (P + 1) == 0 else 0.0)) / (1 - RHO) for i in range(P * P)])
    place = F.row_number().over(W.partitionBy("stratum").orderBy("det", "mu"))
    top = each.withColumn("k", place).where(F.col("k") <= candidates).select("stratum", "blocks", "mu", cov.alias("cov"), "target")
    models = stored(_inverted(top), "mcd-models")
    small = rows.select("stratum", "x")

    def measured(models: DataFrame) -> DataFrame:
        packed = models.groupBy("stratum").agg(F.collect_list(F.struct("det", "mu", "prec", "target")).alias("m"))
        return attach(small, packed, "stratum", "inner").select("stratum", "x", F.posexplode("m").alias("k", "c")).select("stratum", "k", "x", "c.mu", "c.prec", "c.target")

    # in a single block the candidates have settled already
    many = takes.where("blocks > 1").select("stratum").distinct()
    if many.limit(1).count():
        for _ in range(steps):
            far = stored(measured(models.join(many.hint("merge"), "stratum", "left_semi")).select("stratum", "k", "x", "target", mahalanobis().alias("d")), "mcd-distances")
            cut = far.groupBy("stratum", "k").agg(F.percentile_approx("d", share, 10_000).alias("cut"))
            near = attach(far, cut.select(F.concat_ws(" ", "k", "stratum").alias("model"), "cut"), "model", "inner", make=F.concat_ws(" ", "k", "stratum")).where("d <= cut")
            stepped = _inverted(_moments(near, ["stratum", "k"], _consistency(share)))
            models = stored(stepped.unionByName(models.join(many.hint("merge"), "stratum", "left_anti").select(*stepped.columns)), "mcd-models")
    best = models.groupBy("stratum").agg(F.min_by(F.struct("det", "mu", "prec", "target"), F.struct("det", "mu")).alias("b")).select("stratum", "b.*")
    near = measured(best).where(mahalanobis() <= _chi2_quantile(0.975, P))
    return stored(_inverted(_moments(near, ["stratum"], _consistency(0.975))).select("stratum", "mu", "prec"), "mcd-estimates")


# ---------------------------------------------------------------- verdicts


def judged(docs: DataFrame, keep: list[str], name: str, tail: float = 1e-6) -> DataFrame:
    """The columns `keep` of each row of docs, the struct `name` of its statistics, and in it distance2 and kept.

    Estimates come from the different texts of each stratum, so that copies of a text don't make it the norm.
    """
    rows = stored(with_statistics(docs, keep, name), "quality-rows")
    good = rows.where(~F.col(f"{name}.base_failed")).select(f"{name}.*").drop("base_failed")
    by_lang, whole = middles(good)
    langs = good.groupBy("lang").agg(F.count("*").alias("n")).join(by_lang.hint("merge"), "lang")
    langs = langs.select("lang", F.when(F.col("n") >= LEAST, F.col("middle")).otherwise(F.array(*map(F.lit, whole))).alias("middle"))
    langs = stored(langs, "quality-middles")
    vectors = attach(good, langs, "lang").select("fine", "lang", "digest", vector(F.col, F.col("middle")).alias("x")).distinct()
    vectors = stored(vectors, "quality-vectors")
    used, takes = _strata(vectors)
    models = used.join(estimate_strata(vectors, takes).hint("merge"), "stratum").drop("stratum")
    fine, model, x = (free_name(c, [*keep, name]) for c in ("fine", "model", "x"))
    models = vectors.select("fine", "lang").distinct().join(models.hint("merge"), "fine", "left").join(langs.hint("merge"), "lang")
    models = models.select(F.col("fine").alias(fine), F.struct("mu", "prec", "middle").alias(model))
    out = attach(rows, models, fine, "left", make=F.col(f"{name}.fine"))
    out = out.select(*keep, name, model, vector(lambda c: F.col(f"{name}.{c}"), F.col(f"{model}.middle")).alias(x))
    d2 = F.when(~F.col(f"{name}.base_failed"), mahalanobis(x, f"{model}.mu", f"{model}.prec"))
    out = out.select(*keep, name, d2.alias(model))
    kept = ~F.col(f"{name}.base_failed") & F.coalesce(F.col(model) <= _chi2_quantile(1 - tail, P), F.lit(True))
    return out.select(*keep, F.col(name).withField("distance2", F.col(model)).withField("kept", kept).alias(name))


def judge_documents(docs: DataFrame, tail: float = 1e-6) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance2 for each row of docs.

    A document that passes the base rules is rejected if its squared robust distance is beyond the chi-square quantile
    1 - tail (see `vector`). Vectors of documents that fail the base rules take no part in the estimates. Null or empty
    text has no words and fails; null languages and sources are values of their own; with fewer than LEAST different
    texts in the whole table, the base rules alone decide. Repeated rows are judged alike; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    q = judged(docs, ["doc_id"], "q", tail)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"]
    return q.select("doc_id", *[f"q.{c}" for c in cols])


def keep_good_documents(docs: DataFrame, tail: float = 1e-6) -> DataFrame:
    """The rows of docs that judge_documents keeps, with all their columns. Each row is judged by itself, whatever its doc_id."""
    name = free_name("quality", docs.columns)
    return judged(docs, docs.columns, name, tail).where(f"{name}.kept").select(*docs.columns)


def op1_quality(spark, sf_dir) -> DataFrame:
    return judge_documents(read_table(spark, sf_dir, "documents"))
