"""Market regime: inputs per date, the stress gate and a hidden Markov filter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.columns import by_name, expanding_z
from tessera.operators.panel import densify
from tessera.operators.quantiles import gate


def _dates() -> WindowSpec:
    """Along a series of one row per date: that all of it is in one task is no matter."""
    return Window.orderBy("d")


def pairwise_correlation(bars: DataFrame, n: int = 20) -> DataFrame:
    """d, avg_corr, names: mean correlation of all pairs of the names that are complete over the n dates up to d.

    The sum of all correlations is the squared norm of the sum of the standardised returns, so no pair is made: each name standardises
    its window where it stands, and partial sums go to (date, place in the window). A name without variance counts as one, but adds
    nothing. Null with fewer than two names.
    """
    w = by_name().rowsBetween(-(n - 1), 0)
    rows = densify(bars.select("ticker", "d", "close")).withColumn("r", F.ln(F.col("close") / F.lag("close").over(by_name())))
    rows = rows.withColumns({"window": F.collect_list("r").over(w), "mean": F.avg("r").over(w), "sd": F.stddev_samp("r").over(w)}).where(F.size("window") == n)
    flat = F.round("sd", 12) <= 0
    z = F.transform("window", lambda x: F.when(flat, F.lit(0.0)).otherwise((x - F.col("mean")) / F.col("sd")))
    sums = rows.select("d", F.posexplode(z).alias("k", "z")).groupBy("d", "k").agg(F.sum("z").alias("z"), F.count("*").alias("names"))
    out = sums.groupBy("d").agg(F.sum(F.col("z") * F.col("z")).alias("s"), F.max("names").alias("names"))
    k = F.col("names")
    return out.where(k >= 2).select("d", ((F.col("s") / (n - 1) - k) / (k * (k - 1))).alias("avg_corr"), "names")


def market(bars: DataFrame) -> DataFrame:
    """d, level (mean log close) and mkt_ret of the equally weighted market."""
    level = bars.groupBy("d").agg(F.avg(F.ln("close")).alias("level"))
    return level.withColumn("mkt_ret", F.col("level") - F.lag("level").over(_dates()))


def regime_inputs(bars: DataFrame, *, vol: int = 20, corr: int = 20) -> DataFrame:
    """d, mkt_ret, log_vol, avg_corr: return of the market, logarithm of its deviation over `vol` dates, mean pairwise correlation."""
    w = _dates().rowsBetween(-(vol - 1), 0)
    sd = F.when(F.count("mkt_ret").over(w) == vol, F.stddev_samp("mkt_ret").over(w))
    rows = market(bars).select("d", "mkt_ret", F.ln(F.when(sd > 0, sd)).alias("log_vol"))
    return rows.join(pairwise_correlation(bars, corr).select("d", "avg_corr"), "d", "full_outer")


def standardised(inputs: DataFrame, least: int) -> DataFrame:
    """The inputs as expanding z-scores; dates that lack one are left out."""
    z = {c: expanding_z(c, least, _dates()) for c in ("mkt_ret", "log_vol", "avg_corr")}
    return inputs.withColumns(z).dropna("any", subset=list(z))


def panic_gate(inputs: DataFrame, *, least: int = 252, quantile: float = 0.85) -> DataFrame:
    """d, stress, panic: stress is the mean of the two axes of risk, volatility and correlation; panic where it is above the quantile of
    all stress up to that date, of `least` dates at least."""
    stress = standardised(inputs, least).select("d", ((F.col("log_vol") + F.col("avg_corr")) / 2).alias("stress"))
    return gate(stress, "stress", quantile, least).select("d", "stress", "panic")


def known_before(gate: DataFrame) -> DataFrame:
    """d and the panic of the date before in the gate's own table."""
    return gate.select("d", F.coalesce(F.lag("panic").over(_dates()), F.lit(False)).alias("panic"))


def vol_tripwire(bars: DataFrame, *, least: int = 252, limit: float = 0.8) -> DataFrame:
    """Correlation of the gate's volatility axis with a plain one of 21 dates: above the limit the gate adds little to it."""
    m = market(bars)
    plain = _dates().rowsBetween(-20, 0)
    gate_w = _dates().rowsBetween(-19, 0)
    sd = F.when(F.count("mkt_ret").over(gate_w) == 20, F.stddev_samp("mkt_ret").over(gate_w))
    rows = m.select("d", F.ln(F.when(sd > 0, sd)).alias("gate"), F.when(F.count("mkt_ret").over(plain) == 21, F.stddev_samp("mkt_ret").over(plain)).alias("naive"))
    rows = rows.withColumns({c: expanding_z(c, least, _dates()) for c in ("gate", "naive")}).dropna()
    return rows.agg(F.corr("gate", "naive").alias("rho"), F.count("*").alias("n")).withColumn("fails", F.col("rho") > limit)


@dataclass(frozen=True)
class States:
    """A hidden Markov model with Gaussian states: chances at first, of moves (row: from), means and full covariances of each state."""

    start: tuple[float, ...]
    move: tuple[tuple[float, ...], ...]
    means: tuple[tuple[float, ...], ...]
    covs: tuple[tuple[tuple[float, ...], ...], ...]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Rows by states; 0 for rows with a missing value, which tell nothing."""
        out = np.empty((len(x), len(self.start)))
        for j, (mean, cov) in enumerate(zip(self.means, self.covs, strict=True)):
            e = x - np.array(mean)
            out[:, j] = -0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(np.array(cov)), e) + np.linalg.slogdet(2 * np.pi * np.array(cov))[1])
        return np.where(np.isnan(x).any(1)[:, None], 0.0, out)

    def filtered(self, x: np.ndarray, belief: np.ndarray | None = None) -> np.ndarray:
        """The chances of the states at each row, by the rows up to it; belief: those before the first one (none: the start)."""
        move, out = np.array(self.move), np.empty((len(x), len(self.start)))
        for t, row in enumerate(self.log_density(x)):
            a = (np.array(self.start) if belief is None else belief @ move) * np.exp(row - row.max())
            belief = out[t] = a / a.sum()
        return out

    def path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest sequence of states, by the largest product along it and pointers back; the first state among equals."""
        with np.errstate(divide="ignore"):
            start, move = np.log(np.array(self.start)), np.log(np.array(self.move))
        rows = self.log_density(x)
        back, best = np.zeros(rows.shape, np.int64), np.zeros(len(start))
        for t, row in enumerate(rows):
            ways = (best[:, None] + move) if t else np.broadcast_to(start, move.shape)
            back[t] = ways.argmax(0)
            best = ways.max(0) + row
        out = np.zeros(len(rows), np.int64)
        for t in range(len(rows) - 1, -1, -1):
            out[t] = best.argmax() if t == len(rows) - 1 else back[t + 1, out[t + 1]]
        return out


def _along(series: DataFrame, columns: list[str], keys: tuple[str, ...], order: str, name: str, kind: str, of) -> DataFrame:
    schema = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in (*keys, order)) + f", {name} {kind}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf[[*keys, order]].assign(**{name: of(pdf[columns].to_numpy(float, na_value=np.nan))})

    return series.select(*keys, order, *columns).groupBy(*keys).applyInPandas(run, schema)


def state_chances(series: DataFrame, columns: list[str], model: States, *keys: str, order: str = "d") -> DataFrame:
    """keys, order, chances (array<double>): forward filtered chances of the states of a given model along each series, which is one group, a
    row for each date. Rows with a null carry the belief on by the moves alone."""
    return _along(series, columns, keys, order, "chances", "array<double>", lambda x: [list(map(float, a)) for a in model.filtered(x)])


def state_path(series: DataFrame, columns: list[str], model: States, *keys: str, order: str = "d") -> DataFrame:
    """keys, order, state (long): the likeliest path of states of each series as a whole. It looks ahead: for study, never for a decision."""
    return _along(series, columns, keys, order, "state", "long", model.path)


def hmm_filter(series: DataFrame, columns: list[str], *, states: int = 2, train: int = 504, test: int = 63, sticky: float = 10.0, rounds: int = 200) -> DataFrame:
    """d, high_state, converged: chance of the state of the highest mean in the last column, by a Gaussian hidden Markov model of full
    covariances, fitted on the `train` rows before each block of `test` and filtered forward through it, never smoothed.

    Blocks are groups, fitted in parallel; a group is train + test dates. A fit whose log likelihood falls, or isn't a number, is not
    converged: its block gets null.
    """
    kind = dict(series.dtypes)["d"]
    placed = series.dropna("any", subset=columns).withColumn("pos", F.row_number().over(_dates()) - 1)
    last = placed.agg(F.max("pos")).scalar()
    k = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - train - test + 1) / test)), F.floor(F.col("pos") / test))).alias("block")
    blocks = placed.select("d", "pos", last.alias("last"), *columns, k)
    blocks = blocks.where(F.col("block") * test + train <= F.col("last"))

    def density(x, mean, cov):
        out = np.empty((len(x), states))
        for j in range(states):
            e = x - mean[j]
            out[:, j] = -0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov[j]), e) + np.linalg.slogdet(2 * np.pi * cov[j])[1])
        return out

    def forward(logp, start, move):
        alpha, total, now = np.empty(logp.shape), 0.0, start
        for t, row in enumerate(logp):
            top = row.max()
            a = (now if t == 0 else alpha[t - 1] @ move) * np.exp(row - top)
            total += np.log(a.sum()) + top
            alpha[t] = a / a.sum()
        return alpha, total

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        x, s = pdf[columns].to_numpy(float), train
        past = x[:s]
        parts = np.array_split(np.argsort(past[:, -1], kind="stable"), states)
        ridge = np.eye(x.shape[1]) * (past.var(0).mean() * 1e-3 + 1e-12)
        mean, cov = np.array([past[p].mean(0) for p in parts]), np.array([np.cov(past[p].T).reshape(x.shape[1], -1) + ridge for p in parts])
        start, off = np.full(states, 1 / states), 0.05 / max(1, states - 1)
        move = np.full((states, states), off) + np.eye(states) * (0.95 - off)
        before, good = -np.inf, True
        for _ in range(rounds):
            p = density(past, mean, cov)
            alpha, total = forward(p, start, move)
            # the prior on the moves is part of what each round raises
            total += float(((np.ones((states, states)) + np.eye(states) * sticky) * np.log(np.maximum(move, 1e-300))).sum())
            good = np.isfinite(total) and total >= before - 1e-4 * abs(before if np.isfinite(before) else 1)
            if not good or total - before < 1e-8 * abs(total):
                break
            before = total
            lik, beta = np.exp(p - p.max(1, keepdims=True)), np.ones(alpha.shape)
            for t in range(len(past) - 2, -1, -1):
                beta[t] = move @ (lik[t + 1] * beta[t + 1])
                beta[t] /= beta[t].sum()
            g = alpha * beta
            g /= g.sum(1, keepdims=True)
            pair = alpha[:-1, :, None] * move * (lik[1:] * beta[1:])[:, None, :]
            count = (pair / pair.sum((1, 2), keepdims=True)).sum(0) + 1 + np.eye(states) * sticky
            move, start = count / count.sum(1, keepdims=True), g[0]
            mean = (g.T @ past) / g.sum(0)[:, None]
            cov = np.array([(g[:, j, None] * (past - mean[j])).T @ (past - mean[j]) / g[:, j].sum() + ridge for j in range(states)])
        alpha, _ = forward(density(x, mean, cov), start, move)
        high = alpha[s:, int(np.argmax(mean[:, -1]))] if good else np.full(len(x) - s, np.nan)
        return pd.DataFrame({"d": pdf["d"][s:], "high_state": high, "converged": good})

    out = blocks.groupBy("block").applyInPandas(run, f"d {kind}, high_state double, converged boolean")
    return out.withColumn("high_state", F.nanvl("high_state", F.lit(None)))
