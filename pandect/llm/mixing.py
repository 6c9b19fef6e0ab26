"""Mixing sources to target weights by soft membership.

1. A naive-Bayes classifier over hashed tokens is counted from labelled
   documents, at most ``TRAIN_PER_DOMAIN`` of each domain (those with the least
   hash of their id), and predicts every document's domain posterior. A
   document's own label enters as evidence that is wrong with probability
   ``LABEL_NOISE``. Naive Bayes is far too sure of long texts, so a text's
   evidence is its mean per token times the one of ``SCALES`` that foretells the
   labels of held-out documents best: where texts tell nothing of their source
   that is 0, and documents without label fall back to the domains' frequencies.
   Posteriors are held in steps of 1 / ``GRAIN``.
2. A document's rate depends on its posterior and label alone, so documents
   are folded to cells of equal posterior and label with their tokens: the fit
   works on cells, however many documents there are. Per mix, nonnegative rates
   (expected copies) are fitted by projected gradient so that the expected
   tokens of each domain, under the posteriors, come to its target in the
   least-squares sense. A step moves a rate by its posterior-weighted residuals,
   each over its domain's capacity, and projects it onto [0, cap], the cap
   being the repeats allowed to the document's source in the mix. Steps end
   when none of the expected totals moves by more than ``TOLERANCE`` of all
   tokens, or after ``STEPS``; ``shares`` reports what is left. A step is one
   aggregation over the cells that sends mixes x domains numbers to the driver.
3. A source falls short where the fit has all its documents at their cap and
   still misses the target (the optimality condition of the bound).
4. Copies are made of rates by systematic rounding: along each source's
   documents, ordered by size, a copy is made wherever the running sum of rates
   passes a whole number. So copies never exceed the cap and a source misses
   its rates' tokens by about one document. The sums run in strata (size and a
   hash), so no task needs a whole source.

Targets are tokens: a source's share is its weight over its mix's weights,
taken of the tokens of all documents.

Cases: target rows without weight or source, or with weight 0, ask for
nothing; equal rows count once, and different rows of one source in a mix add
their weights and take the larger cap; without cap a document is used once;
documents without text have no tokens and no copies; documents without label
belong to their most probable domain; documents of sources outside of a mix
aren't used in it; a target without documents reaches 0 and falls short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pandect.functions.text import TOKEN, source_key, token_count
from pandect.plans.cut import stored

TRAIN_PER_DOMAIN = 2_000
BUCKETS = 2_048
SCALES = (0.0, 1.0, 4.0, 16.0, 64.0)
LABEL_NOISE = 0.001
GRAIN = 256
STEPS = 60
TOLERANCE = 1e-5
#: Part of what its documents allow that the fit must use of a source before it can be said to fall short.
AT_CAP = 0.99
#: Strata per size of a document along which copies are rounded.
STRATA = 64
#: The mix table is configuration; more rows than this are refused rather than sent to the driver.
MOST_TARGETS = 100_000


def targets_of(mix_targets: DataFrame) -> DataFrame:
    """``mix_id, source, weight, max_repeats, share`` of what is asked for."""
    rows = mix_targets.select("mix_id", source_key(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), "max_repeats").distinct()
    rows = rows.where("mix_id is not null and source <> '' and weight > 0")
    rows = rows.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    return rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("mix_id")))


def _sized(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.nullif(source_key(F.col("source")), F.lit("")).alias("label"), "text")


def _hashed(text: Column, buckets: int) -> Column:
    """Bucket of every token in any case; null for null. Its size is the number of tokens."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.pmod(F.xxhash64(F.lower(t)), F.lit(buckets)).cast("smallint"))


class Classifier:
    """Naive Bayes: ``likelihood`` (domains x buckets), ``prior``, the ``scale``
    of a text's mean evidence, and how it fared on ``held_out`` documents:
    per domain how many there were and how many the text alone named right."""

    def __init__(self, documents: DataFrame, domains: list[str], per_domain: int = TRAIN_PER_DOMAIN, buckets: int = BUCKETS):
        self.domains = domains
        place = {d: i for i, d in enumerate(domains)}
        labelled = _sized(documents).where(F.col("label").isin(domains) & F.col("text").isNotNull())
        # The sample is cut by rank within the domain before any text moves: one hash per domain tells its last.
        first = Window.partitionBy("label").orderBy("__h")
        ranked = labelled.select("label", F.xxhash64("doc_id").alias("__h")).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_domain)
        last = ranked.groupBy("label").agg(F.max("__h").alias("__last"))  # at most MOST_TARGETS rows
        sample = stored(labelled.join(F.broadcast(last), "label").where(F.xxhash64("doc_id") <= F.col("__last")).select("label", _hashed(F.col("text"), buckets).alias("hashed"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("kept")))
        # At most domains x buckets counts reach the driver, for either half of the sample.
        counted = sample.select("label", "kept", F.explode("hashed").alias("bucket")).groupBy("label", "kept", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = np.zeros((2, len(domains), buckets))
        for r in counted:
            counts[int(r["kept"]), place[r["label"]], r["bucket"]] += r["n"]
        log = lambda c: np.log((c + 0.5) / (c + 0.5).sum(1, keepdims=True))
        self.likelihood = log(counts.sum(0))
        seen = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.prior = np.log(np.array([seen.get(d, 0) + 1e-6 for d in domains]))
        self.scale, self.held_out = self._calibrated(sample.where("not kept"), log(counts[1]), place)

    def _calibrated(self, held: DataFrame, likelihood: np.ndarray, place: dict[str, int]) -> tuple[float, dict[str, tuple[int, int]]]:
        prior, k = self.prior, len(self.domains)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                e, own = _evidence(b["hashed"], likelihood), b["label"].map(place).to_numpy(int)
                at = np.arange(len(b))
                losses = []
                for scale in SCALES:
                    z = e * scale + prior
                    z -= z.max(1, keepdims=True)
                    losses.append(-(z[at, own] - np.log(np.exp(z).sum(1))))
                right = e.argmax(1) == own if len(b) else own == 0
                yield pd.DataFrame({"own": own, "right": right.astype(float), **{f"l{i}": x for i, x in enumerate(losses)}})

        rows = held.mapInPandas(judge, "own int, right double, " + ", ".join(f"l{i} double" for i in range(len(SCALES))))
        got = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("right"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(len(SCALES))]).collect()
        losses = [sum(r[f"l{i}"] for r in got) for i in range(len(SCALES))]
        return SCALES[int(np.argmin(losses))] if k else 0.0, {self.domains[r["own"]]: (r["n"], int(r["right"])) for r in got}


def _evidence(hashed: pd.Series, likelihood: np.ndarray) -> np.ndarray:
    """Mean log evidence of the tokens of each text (documents x domains)."""
    logp = np.zeros((len(hashed), likelihood.shape[0]))
    for i, h in enumerate(hashed):
        if len(h):
            logp[i] = likelihood[:, np.asarray(h, np.int64)].mean(1)
    return logp


def posteriors(documents: DataFrame, classifier: Classifier, noise: float = LABEL_NOISE, grain: int = GRAIN) -> DataFrame:
    """``doc_id, label, tokens, posterior``: the posterior over the classifier's
    domains in order, in steps of 1 / ``grain``."""
    likelihood, prior, scale, k = classifier.likelihood, classifier.prior, classifier.scale, len(classifier.domains)
    place = {d: i for i, d in enumerate(classifier.domains)}
    rows = _sized(documents)
    # Without use for the text's evidence only its tokens are counted.
    text = F.coalesce(_hashed(F.col("text"), likelihood.shape[1]), F.array().cast("array<smallint>")) if scale else F.array().cast("array<smallint>")
    rows = rows.select("doc_id", "label", token_count(F.col("text")).cast("bigint").alias("tokens"), text.alias("hashed"))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            logp = (_evidence(b["hashed"], likelihood) * scale if scale else 0.0) + np.tile(prior, (len(b), 1))
            own = b["label"].map(place)
            at = np.flatnonzero(own.notna())
            # A label is evidence of its own; the domains' frequencies serve those without.
            logp[at] += np.log(noise / max(k - 1, 1)) - prior
            logp[at, own.iloc[at].astype(int)] += np.log(1 - noise) - np.log(noise / max(k - 1, 1))
            p = np.exp(logp - logp.max(1, keepdims=True))
            p = np.rint(p / p.sum(1, keepdims=True) * grain).astype(np.int16)
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "tokens": b["tokens"], "posterior": list(p)})

    return rows.mapInPandas(predict, "doc_id bigint, label string, tokens bigint, posterior array<smallint>")


def heldout(documents: DataFrame) -> DataFrame:
    """``source, documents, named_right``: of the documents held out from
    counting, how often the text alone names the source."""
    domains = [r[0] for r in _sized(documents).where("label is not null").select("label").distinct().sort("label").limit(MOST_TARGETS).collect()]
    held = Classifier(documents, domains).held_out if domains else {}
    return documents.sparkSession.createDataFrame([(d, n, right) for d, (n, right) in held.items()], "source string, documents bigint, named_right bigint")


def rates(posterior: np.ndarray, cap: np.ndarray, capacity: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Rates of documents (or cells) in one mix after the steps whose residuals
    (steps x domains) are given."""
    r = np.zeros_like(cap)
    for e in residuals:
        r = np.clip(r - posterior @ (e / capacity), 0.0, cap)
    return r


def _owners(label: pd.Series, posterior: np.ndarray, domains: list[str]) -> np.ndarray:
    """Domain that a document counts to: its label, -1 if that is outside of
    the domains, or its most probable domain if it has none."""
    place = {d: i for i, d in enumerate(domains)}
    own = label.map(lambda x: place.get(x, -1), na_action="ignore").to_numpy(dtype=float, na_value=np.nan)
    return np.where(np.isnan(own), posterior.argmax(1), own).astype(int) if len(label) else np.empty(0, int)


class Fit:
    """A fitted mix: ``soft`` (documents with posteriors) and ``cells`` (stored),
    ``domains``, ``mixes``, ``goal`` and ``repeats`` (mixes x domains),
    ``residuals`` of all steps (steps x mixes x domains)."""

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, steps: int = STEPS, tolerance: float = TOLERANCE):
        wanted = targets_of(mix_targets).limit(MOST_TARGETS + 1).collect()
        if len(wanted) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        self.domains = sorted({w["source"] for w in wanted})
        self.mixes = sorted({w["mix_id"] for w in wanted})
        self.wanted = wanted
        m, k = {x: i for i, x in enumerate(self.mixes)}, {x: i for i, x in enumerate(self.domains)}
        share, self.repeats = np.zeros((len(m), len(k))), np.zeros((len(m), len(k)))
        for w in wanted:
            share[m[w["mix_id"]], k[w["source"]]] = w["share"]
            self.repeats[m[w["mix_id"]], k[w["source"]]] = w["max_repeats"]
        self.classifier = Classifier(documents, self.domains) if wanted else None
        self.soft = stored(posteriors(documents, self.classifier)) if wanted else None
        self.total = 0
        self.residuals = np.zeros((0, *share.shape))
        if not wanted:
            return
        self.cells = stored(self.soft.groupBy("label", "posterior").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
        self.capacity = np.maximum(self._sums(lambda b, p, own: (b["tokens"].to_numpy(float)[:, None] * p).sum(0)[None, :], 1)[0], 1.0)
        self.total = int(self.cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
        self.goal = share * self.total
        before = np.zeros_like(share)
        for step in range(steps):
            reached = self._reached()
            if step and np.abs(reached - before).max() <= tolerance * max(self.total, 1):
                break
            before = reached
            self.residuals = np.concatenate([self.residuals, (reached - self.goal)[None]])
        self.expected = reached if steps else before

    def _sums(self, of, rows: int) -> np.ndarray:
        """Sum over all cells of a rows x domains array, one partial per batch,
        combined by Spark."""
        k, domains = len(self.domains), self.domains

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    p = np.stack(b["posterior"].to_numpy()) / GRAIN
                    yield pd.DataFrame({"at": np.arange(rows * k), "v": of(b, p, _owners(b["label"], p, domains)).reshape(-1)})

        got = self.cells.mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(rows * k)
        for r in got:
            out[r["at"]] = r["v"]
        return out.reshape(rows, k)

    def _reached(self) -> np.ndarray:
        """Expected tokens of each domain in each mix at the present rates."""
        repeats, capacity, residuals = self.repeats, self.capacity, self.residuals

        def of(b: pd.DataFrame, p: np.ndarray, own: np.ndarray) -> np.ndarray:
            tokens = b["tokens"].to_numpy(float)
            out = np.zeros((len(repeats), p.shape[1]))
            for j in range(len(repeats)):
                cap = np.where(own >= 0, repeats[j][np.maximum(own, 0)], 0.0)
                out[j] = (rates(p, cap, capacity, residuals[:, j]) * tokens) @ p
            return out

        return self._sums(of, len(self.mixes))

    def rated_cells(self) -> DataFrame:
        """``mix_id, label, posterior, source, rate`` of cells and mixes with a rate above 0."""
        domains, repeats, capacity, residuals, mixes = self.domains, self.repeats, self.capacity, self.residuals, self.mixes

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                p = np.stack(b["posterior"].to_numpy()) / GRAIN
                own = _owners(b["label"], p, domains)
                for j, mix in enumerate(mixes):
                    cap = np.where(own >= 0, repeats[j][np.maximum(own, 0)], 0.0)
                    r = rates(p, cap, capacity, residuals[:, j])
                    at = np.flatnonzero(r > 0)
                    yield pd.DataFrame({"mix_id": mix, "label": b["label"].iloc[at], "posterior": b["posterior"].iloc[at], "tokens": b["tokens"].iloc[at], "source": np.asarray(domains, object)[own[at]], "rate": r[at]})

        return self.cells.mapInPandas(of, "mix_id int, label string, posterior array<smallint>, tokens bigint, source string, rate double")

    def copies(self) -> DataFrame:
        """``mix_id, doc_id, source, tokens, rate, copies``; documents without copies don't appear."""
        cells = stored(self.rated_cells().drop("tokens")).withColumnRenamed("label", "__label").withColumnRenamed("posterior", "__posterior")
        same = F.col("label").eqNullSafe(F.col("__label")) & (F.col("posterior") == F.col("__posterior"))
        rows = self.soft.where("tokens > 0").join(cells, same).select("mix_id", "doc_id", "source", "tokens", "rate")
        rows = rows.withColumn("__stratum", F.pmod(F.xxhash64("doc_id"), F.lit(STRATA)))
        # The running sum of rates, up to and with each document: within a stratum by a
        # window, from stratum to stratum by the strata's sums.
        place = ["mix_id", "source", "tokens", "__stratum"]
        strata = rows.groupBy(*place).agg(F.sum("rate").alias("__sum"))
        along = Window.partitionBy("mix_id", "source").orderBy("tokens", "__stratum").rowsBetween(Window.unboundedPreceding, -1)
        strata = strata.select(*place, F.coalesce(F.sum("__sum").over(along), F.lit(0.0)).alias("__before"))
        inside = Window.partitionBy(*place).orderBy("doc_id", "rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("__upto", F.sum("rate").over(inside)).join(strata, place)
        # Sums are rounded to a millionth, so the order of addition doesn't show.
        level = lambda c: F.floor(F.round(c, 6) + 0.5)
        upto = F.col("__before") + F.col("__upto")
        rows = rows.withColumn("copies", F.least(level(upto) - level(upto - F.col("rate")), F.ceil(F.round("rate", 6))).cast("int"))
        return rows.where("copies > 0").select("mix_id", "doc_id", "source", "tokens", "rate", "copies")

    def wanted_rows(self) -> DataFrame:
        """``mix_id, source, target_share, max_repeats, all_tokens, expected_tokens``."""
        m, k = {x: i for i, x in enumerate(self.mixes)}, {x: i for i, x in enumerate(self.domains)}
        rows = [(w["mix_id"], w["source"], w["share"], int(w["max_repeats"]), self.total, float(self.expected[m[w["mix_id"]], k[w["source"]]])) for w in self.wanted]
        return self.soft.sparkSession.createDataFrame(rows, "mix_id int, source string, target_share double, max_repeats int, all_tokens bigint, expected_tokens double")

    def shares(self) -> DataFrame:
        """Per mix and source: target, expected and reached tokens and shares, what
        there is (``available_tokens``, by label) and what repeats allow of it."""
        there = self.cells.groupBy(F.col("label").alias("source")).agg(F.sum("tokens").alias("available_tokens"))
        got = self.copies().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"))
        whole = got.groupBy("mix_id").agg(F.sum("reached_tokens").alias("mix_tokens"))
        out = self.wanted_rows().join(there, "source", "left").join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").na.fill(0, ["available_tokens", "reached_tokens", "mix_tokens"])
        reached = F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(0.0)
        return out.withColumn("target_tokens", F.col("target_share") * F.col("all_tokens")).withColumn("reached_share", reached)

    def shortfalls(self) -> DataFrame:
        """``mix_id, source`` where the fit has the source's documents at their cap
        and what they give then is still less than the target."""
        there = self.cells.where("label is not null").groupBy(F.col("label").alias("source")).agg(F.sum("tokens").alias("available_tokens"))
        used = self.rated_cells().where(F.col("label") == F.col("source")).groupBy("mix_id", "source").agg(F.sum(F.col("rate") * F.col("tokens")).alias("used"))
        out = self.wanted_rows().join(there, "source", "left").join(used, ["mix_id", "source"], "left").na.fill(0, ["available_tokens", "used"])
        allowed = F.col("available_tokens") * F.col("max_repeats")
        at_cap = F.col("used") >= F.lit(AT_CAP) * allowed
        return out.where(at_cap & (allowed < F.col("target_share") * F.col("all_tokens"))).select("mix_id", "source")


def shares(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """The report of a mix: what each source should and does contribute;
    ``expected_tokens`` is what the fit gives its domain before rounding."""
    fit = Fit(documents, mix_targets)
    if fit.soft is None:
        return documents.sparkSession.createDataFrame([], "mix_id int, source string, target_share double, reached_share double, target_tokens double, expected_tokens double, reached_tokens bigint, available_tokens bigint, max_repeats int")
    return fit.shares().select("mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round("reached_share", 6).alias("reached_share"), F.round("target_tokens", 3).alias("target_tokens"), F.round("expected_tokens", 3).alias("expected_tokens"), "reached_tokens", "available_tokens", "max_repeats")


def chosen(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``mix_id, doc_id, source, tokens, rate, copies``: the mixes themselves."""
    fit = Fit(documents, mix_targets)
    if fit.soft is None:
        return documents.sparkSession.createDataFrame([], "mix_id int, doc_id bigint, source string, tokens bigint, rate double, copies int")
    return fit.copies()


def verified(documents: DataFrame, mix_targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per mix and source what is asked and what there is, and of the mix itself
    whether it holds: no document beyond its repeats (``within_repeats``), and
    the tokens of the target, or all that repeats allow if that is less, reached
    to ``tolerance`` or one document (``reached``)."""
    fit = Fit(documents, mix_targets)
    if fit.soft is None:
        return documents.sparkSession.createDataFrame([], "mix_id int, source string, target_tokens double, available_tokens bigint, max_repeats int, within_repeats boolean, reached boolean")
    used = fit.copies().groupBy("mix_id", "source").agg(F.max("copies").alias("most"), F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.max("tokens").alias("largest"))
    there = fit.cells.groupBy(F.col("label").alias("source")).agg(F.sum("tokens").alias("available_tokens"))
    out = fit.wanted_rows().join(there, "source", "left").join(used, ["mix_id", "source"], "left").na.fill(0, ["available_tokens", "most", "got", "largest"])
    aim = F.least(F.col("target_share") * F.col("all_tokens"), (F.col("available_tokens") * F.col("max_repeats")).cast("double"))
    near = F.abs(F.col("got") - aim) <= F.greatest(F.lit(tolerance) * aim, F.col("largest"))
    return out.select("mix_id", "source", F.round(F.col("target_share") * F.col("all_tokens"), 3).alias("target_tokens"), "available_tokens", "max_repeats", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), near.alias("reached"))


def found(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``mix_id, source`` of the sources that fall short in the fitted mix."""
    fit = Fit(documents, mix_targets)
    if fit.soft is None:
        return documents.sparkSession.createDataFrame([], "mix_id int, source string")
    return fit.shortfalls()
