"""Mixing a corpus to target weights of soft domains.

A table of labels gives some documents a domain. A classifier learned from them (multinomial logistic
regression on the presence of words) gives every document posteriors over the domains, so a document counts towards
each domain by its share. Rates r >= 0 of the documents (how often one is used) are then fitted so that the expected tokens of each domain,
S_k = sum_d r_d tokens_d p_dk, meet the targets T_k: the least-squares problem

    min over r >= 0 of  sum_k (S_k - T_k)^2 / (2 m_k),   m_k the domain's tokens at rate 1

by projected gradient from r = 1. In the metric that weighs documents by their tokens, the step is

    r_d <- min(max_rate, max(0, y_d - sum_k p_dk (S_k(y) - T_k) / m_k)),   y = r + b (r - the r before)

with the usual momentum b, taken back to zero where the objective rises. Step size one is safe on any data: as posteriors sum to one, the
Hessian's rows (scaled by 1 / m_k) sum to at most one, so no eigenvalue exceeds it. A round is one aggregation of as many numbers as there
are domains (S is linear, so S(y) needs none); the rates themselves are never stored or collected, as each document replays the rounds' few
residuals. A fit that has not settled after `rounds` warns, and the report says so.

Classifier: one row of each labelled id, one of each text of a domain, the `fit_rows` with the lowest hash of their id.
Of the features (words, the share in tenths of each word shape, the share of distinct words) those `features` that tell the domains best by the G
statistic come to the driver, and an L1 penalty keeps those that explain PENALTY rows that nothing else does (single copied texts
thus bring no words in), whose weights are then fitted again.
These bounds hold at any size; all else covers all documents. Tokens are the words of a text.

Defined cases: a null or empty text has no tokens, the sample's shares as posteriors, and takes the same rate rule; a long text is
one row like any other, its words counted once each. Without labelled rows posteriors are uniform. A label of unknown domain or null is not used; a
document with several labels uses the first domain in order, an id with several texts the first in order. A domain without tokens is left out of the fit.
Repeated rows and null ids get a row each; rows with the same id and text get the same copies. Ties in the G statistic go by name. An
empty table gives no rows. Other columns are not read; with `keep_row` they come back unchanged in a struct, so no name can clash.
"""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import row_struct, text_or_empty, text_runs, texts_of, tidy, written

FIT_ROWS, FEATURES, MIN_ROWS, PENALTY, AGAIN, EPOCHS = 6000, 1024, 4, 1.0, 0.3, 300
#: domain: condition on the labels table
DOMAINS = {"good": "quality = 1 and toxic = 0", "poor": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
MARKS = ".,;:!?\"'()"
#: Longer names of features are replaced by their hash
NAME = 64


def _named(kind: str, names: pa.Array) -> pa.Array:
    """Names of features, long ones hashed."""
    long = np.flatnonzero(pc.greater(pc.binary_length(names), NAME).to_numpy(zero_copy_only=False))
    if len(long):
        own = names.to_pylist()
        for k in long.tolist():
            own[k] = hashlib.blake2b(own[k].encode(), digest_size=16).hexdigest()
        names = pa.array(own, pa.string())
    return pc.binary_join_element_wise(kind, names.cast(pa.string()), ":")


def _distinct(doc: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, code, how often) of the distinct pairs; codes are under n."""
    key, times = np.unique(doc * np.int64(max(1, n)) + code, return_counts=True)
    return key // max(1, n), key % max(1, n), times


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, and (text, feature) pairs, each once, with the features' names.

    Features are each word (case and marks at its ends don't count), the share in tenths of each word shape (runs of
    capitals as A, of other letters as a, of digits as 0: Aa, A!, a$), and the share of distinct words.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()) if texts.nbytes < 1 << 30 else texts.cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts)), sizes)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[index] if len(words) else np.zeros(0, bool)
    doc, index = doc[full], index[full]
    n = np.bincount(doc, minlength=len(texts))
    low = pc.utf8_lower(words)
    plain = pc.utf8_trim(low, MARKS)
    plain = pc.if_else(pc.equal(plain, ""), low, plain).dictionary_encode()
    shape = words
    for pattern, kind in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a"), (r"\p{Nd}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, kind)
    shape = shape.dictionary_encode()
    held, word, _ = _distinct(doc, index, len(words))
    distinct = np.bincount(held, minlength=len(texts))
    held, word, _ = _distinct(held, plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[word], len(plain.dictionary))
    own, kind, times = _distinct(doc, shape.indices.to_numpy(zero_copy_only=False).astype(np.int64)[index], len(shape.dictionary))
    share = 10 * times // np.maximum(1, n[own])
    _, shared, _ = _distinct(np.zeros(len(kind), np.int64), kind * 11 + share, 11 * max(1, len(shape.dictionary)))
    shapes = pc.binary_join_element_wise(_named("s", shape.dictionary.take(pa.array(shared // 11))), pa.array(shared % 11).cast(pa.string()), ":")
    names = pa.concat_arrays([_named("w", plain.dictionary), shapes, pa.array([f"d:{k}" for k in range(11)], pa.string())])
    some = np.flatnonzero(n)
    doc = np.concatenate([held, own, some])
    code = np.concatenate([word, len(plain.dictionary) + np.searchsorted(shared, kind * 11 + share), len(names) - 11 + 10 * distinct[some] // n[some]])
    return n, doc, code, names


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    names: list[str]
    weights: np.ndarray  # features x domains
    base: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and its posteriors."""
        n, doc, code, names = features(texts)
        z = np.tile(self.base, (len(n), 1))
        if self.names:
            place = pc.index_in(names, value_set=pa.array(self.names, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)[code]
            doc, place = doc[place >= 0], place[place >= 0]
            z += np.stack([np.bincount(doc, self.weights[place, k], len(n)) for k in range(len(self.domains))], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
        return n, np.where(n[:, None] > 0, e / e.sum(axis=1, keepdims=True), self.prior)


def _proximal(x: np.ndarray, target: np.ndarray, base: np.ndarray, penalty: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the logistic regression with an L1 penalty, by proximal gradient with momentum."""
    n = len(x)
    step = np.float32(1 / (0.5 * (np.linalg.norm(x, 2) ** 2 / n + 1)))
    least = np.float32(penalty / n) * step
    w = before = look = np.zeros((x.shape[1], target.shape[1]), np.float32)
    b = b_look = base.astype(np.float32)
    t = 1.0
    for _ in range(epochs):
        z = x @ look + b_look
        e = np.exp(z - z.max(axis=1, keepdims=True))
        gap = e / e.sum(axis=1, keepdims=True) - target
        w = look - step * (x.T @ gap) / n
        w = np.sign(w) * np.maximum(0, np.abs(w) - least)
        b_new = b_look - step * gap.mean(axis=0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = np.float32((t - 1) / t_new)
        look, b_look, moved = w + m * (w - before), b_new + m * (b_new - b), np.abs(w - before).max()
        before, b, t = w, b_new, t_new
        if moved < 1e-4:
            break
    return w, b


def fit_classifier(rows: list[tuple[int, np.ndarray]], domains: list[str], names: list[str], *, penalty: float = PENALTY, again: float = AGAIN, epochs: int = EPOCHS) -> Classifier:
    """rows: (domain's number, its features' numbers). The same rows give the same classifier.

    Fitted twice: the features that the first penalty leaves are fitted again with a smaller one, as the first makes their weights too small.
    """
    k, n = len(domains), len(rows)
    prior = (np.bincount([y for y, _ in rows], minlength=k) + 1) / (n + k) if rows else np.full(k, 1 / k)
    x = np.zeros((n, len(names)), np.float32)
    for i, (_, own) in enumerate(rows):
        x[i, own] = 1
    target = np.eye(k, dtype=np.float32)[np.array([y for y, _ in rows], int)]
    used, b, w = np.arange(len(names)), np.log(prior), np.zeros((0, k))
    for strength in (penalty, again):
        if not n or not len(used):
            break
        w, b = _proximal(x[:, used], target, np.log(prior), strength, epochs)
        stay = np.abs(w).max(axis=1) > 0
        used, w = used[stay], w[stay]
    return Classifier(domains, prior, [names[j] for j in used], w.astype(float), b.astype(float))


def _named_features(batches):
    for b in batches:
        for at, texts in text_runs(b.column(1)):
            n, doc, code, names = features(texts)
            order = np.argsort(doc, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]), pa.int32()), names.take(pa.array(code[order])))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), lists], ["y", "names"])


def learn(docs: DataFrame, labels: DataFrame, *, domains: dict[str, str] = DOMAINS, fit_rows: int = FIT_ROWS, n_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    names = list(domains)
    number = F.coalesce(*[F.when(F.expr(cond), F.lit(k)) for k, cond in enumerate(domains.values())])
    told = labels.select(F.col(id_col).alias("id"), number.alias("y")).where("y is not null and id is not null").groupBy("id").agg(F.min("y").alias("y"))
    picked = told.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    one = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("y", "text")).alias("r")).select("r.*").distinct()  # picked has at most fit_rows rows
    rows = written(one.mapInArrow(_named_features, "y int, names array<string>"), "fit-rows")
    have = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(have.values())
    counts = rows.select("y", F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("y") == k, 1)).alias(f"n{k}") for k in have])
    told_by = F.lit(0.0)
    for k, of in have.items():
        for seen, wanted in ((F.col(f"n{k}"), F.col("n") * of / total), (of - F.col(f"n{k}"), (total - F.col("n")) * of / total)):
            told_by = told_by + F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)
    top = [r.name for r in counts.where(F.col("n") >= MIN_ROWS).orderBy(F.round(told_by, 6).desc(), "name").limit(n_features).collect()]

    def found(batches):
        known = pa.array(top, pa.string())
        for b in batches:
            code = pc.index_in(b.column(1).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            at = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()
            own = [np.sort(c[c >= 0]) for c in np.split(code, at[1:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tolist() for x in own], pa.list_(pa.int32()))], ["y", "found"])

    got = sorted((r.y, list(r.found)) for r in rows.mapInArrow(found, "y int, found array<int>").collect())  # at most fit_rows lists of n_features
    return fit_classifier([(y, np.array(own, np.int64)) for y, own in got], names, top)


def score(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, keep_row: bool = False) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, chance (from 0 to 1, by id and text), and the whole row if that is to be kept.

    The model has at most as many features as `learn` looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = [f"p_{d}" for d in model.domains]
    chance = F.pmod(F.xxhash64(F.col(id_col), text_or_empty(text_col), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    text = row_struct(docs) if keep_row else text_or_empty(text_col).alias("text")
    rows, columns = docs.select(F.col(id_col).alias("doc_id"), chance.alias("chance"), text), docs.columns

    def run(batches):
        m = sent.value
        for b in batches:
            all_texts = texts_of(b, columns, text_col) if keep_row else b.column(2)
            names = b.schema.names if keep_row else ["doc_id", "chance"]
            for at, texts in text_runs(all_texts):
                n, p = m.posteriors(texts)
                own = [c.slice(at, len(n)) for c in b.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), *(pa.array(p[:, j].copy(), pa.float64()) for j in range(len(cols)))], [*names, "n_tokens", *cols])

    schema = StructType([f for f in rows.schema if f.name != "text"]).add("n_tokens", "long")
    for c in cols:
        schema = schema.add(c, "double")
    return rows.mapInArrow(tidy(run), schema)


def rate(steps: list[tuple[float, list[float]]], cols: list[str], max_rate: float | None):
    """A document's rate after the given rounds; steps: momentum and (S_k - T_k) / m_k of each."""
    if not steps:
        return F.lit(1.0)
    rows = ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in (b, *s)) + ")" for b, s in steps)
    look = "a.r + s[0] * (a.r - a.before)"
    move = " + ".join(f"s[{k + 1}] * `{c}`" for k, c in enumerate(cols))
    new = f"greatest(0.0D, {look} - ({move}))"
    new = new if max_rate is None else f"least({float(max_rate)!r}D, {new})"
    return F.expr(f"aggregate(array({rows}), struct(1.0D as r, 1.0D as before), (a, s) -> struct({new} as r, a.r as before)).r")


def fit_rates(scored: DataFrame, targets: dict[str, float], *, anchor: str | None = None, max_rate: float | None = None, rounds: int = 60, tolerance: float = 1e-3) -> tuple[list[tuple[float, list[float]]], dict]:
    """The rounds' momenta and residuals, and a report. scored is read once a round, so it should be a written table.

    targets are relative weights. Their sum stands for all present tokens, or, with an anchor, for so many that this
    domain's target is its present tokens. The fit has settled when all targets are met within the tolerance, or a round without
    momentum moves no domain's tokens by over a fifth of it: then the constraints leave no more.
    """
    cols = [f"p_{d}" for d in targets]
    mass = lambda r: np.array(scored.select("n_tokens", *cols, r.alias("_r")).agg(*[F.coalesce(F.sum(F.expr(f"n_tokens * `{c}` * _r")), F.lit(0.0)) for c in cols]).first(), float)
    m = mass(F.lit(1.0))
    weights = np.array(list(targets.values()), float) / sum(targets.values())
    total = m.sum() if anchor is None else m[list(targets).index(anchor)] / weights[list(targets).index(anchor)]
    want, now, before, steps = weights * total, m, m, []
    scale = np.array([1 / x if x > 0 else 0.0 for x in m])
    cost = lambda s: float((((s - want) ** 2) * scale).sum())
    t, b, settled = 1.0, 0.0, False
    while not (settled := settled or bool(np.abs((now - want) * scale).max(initial=0) <= tolerance)) and len(steps) < rounds:
        look = now + b * (now - before)
        trial = [*steps, (b, ((look - want) * scale).tolist())]
        then = mass(rate(trial, cols, max_rate))
        if b and cost(then) > cost(now):  # back to a plain step from here
            steps, t, b = trial, 1.0, 0.0
            before, now = then, then
            continue
        settled = not b and bool(np.abs((then - now) * scale).max() < tolerance / 5)
        small = np.abs((then - look) * scale).max() < tolerance / 5
        steps, before, now = trial, now, then
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        t, b = (1.0, 0.0) if small else (t_new, float((t - 1) / t_new))
    if not settled:
        warnings.warn(f"rates have not settled after {rounds} rounds: {dict(zip(targets, now / np.maximum(want, 1e-9)))} of the wanted tokens", stacklevel=2)
    return steps, {"domains": list(targets), "present": m.tolist(), "wanted": want.tolist(), "expected": now.tolist(), "rounds": len(steps), "settled": settled}


def mix(scored: DataFrame, targets: dict[str, float], *, max_rate: float | None = None, **options) -> DataFrame:
    """scored with rate and copies: the rate rounded up or down by the row's chance, so that its expectation is the rate."""
    steps, _ = fit_rates(scored, targets, max_rate=max_rate, **options)
    out = scored.withColumn("rate", rate(steps, [f"p_{d}" for d in targets], max_rate))
    return out.withColumn("copies", (F.floor("rate") + F.when(F.col("chance") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")).drop("chance")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, domains: dict[str, str] = DOMAINS, fit_rows: int = FIT_ROWS, keep_row: bool = False, **options) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every document, and its whole row as `row` if that is to be kept."""
    model = learn(docs, labels, domains={d: domains[d] for d in targets}, fit_rows=fit_rows)
    return mix(written(score(docs, model, keep_row=keep_row), "posteriors"), targets, **options)
