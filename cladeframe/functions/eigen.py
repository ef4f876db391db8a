"""Leading eigenpairs of a large symmetric matrix with centred rows and columns, by block Lanczos steps.

The matrix stays in square blocks on the executors and is never centred itself: the vector of ones counts as the
first basis vector, and whatever is kept orthogonal to it is centred. A step multiplies the blocks with a few
columns of one number a row and makes the result orthogonal to the basis. The driver sees products of basis
columns only, at most ``basis`` x ``basis`` numbers whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cladeframe.functions.lineage import cut

BLOCK = 512
#: Columns up to this size are sent to every executor; larger ones meet the blocks by a shuffle.
BROADCAST_BYTES = 64 << 20


@dataclass
class Spectrum:
    """Eigenvalues found, their vectors (b, y: rows x found), and the sum of all positive ones, exact or estimated."""

    values: np.ndarray
    vectors: DataFrame
    positive: float
    exact: bool


def _array(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


def _rows(b: int, n: int) -> int:
    return min(BLOCK, n - b * BLOCK)


def square_blocks(cells: DataFrame, n: int) -> DataFrame:
    """(bi <= bj, m): dense blocks of the symmetric matrix with the cells (i, j, v), 0 <= i, j < n.

    A cell stands for both (i, j) and (j, i); absent cells and null values are 0.
    """

    def dense(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[0]), int(key[1])
        m = np.zeros((_rows(bi, n), _rows(bj, n)))
        i, j = pdf["i"].to_numpy() - bi * BLOCK, pdf["j"].to_numpy() - bj * BLOCK
        m[i, j] = pdf["v"].to_numpy()
        if bi == bj:
            m[j, i] = pdf["v"].to_numpy()
        return pd.DataFrame({"bi": [bi], "bj": [bj], "m": [m.tobytes()]})

    low, high = F.least("i", "j"), F.greatest("i", "j")
    placed = cells.filter("v is not null").select(
        low.alias("i"), high.alias("j"), "v", F.floor(low / BLOCK).alias("bi"), F.floor(high / BLOCK).alias("bj"))
    return cut(placed.groupBy("bi", "bj").applyInPandas(dense, "bi long, bj long, m binary"))


def _multiply(blocks: DataFrame, columns: DataFrame, n: int, width: int) -> DataFrame:
    """(b, w): matrix times ``columns`` (b, q). A task adds up what it has of a block before it is sent."""

    def partial(batches):
        sums: dict[int, np.ndarray] = {}

        def out():
            frame = pd.DataFrame({"b": list(sums), "w": [w.tobytes() for w in sums.values()]})
            sums.clear()
            return frame

        for pdf in batches:
            for bi, bj, m, qi, qj in pdf.itertuples(index=False):
                a = _array(m, _rows(bi, n))
                sums[bi] = sums.get(bi, 0.0) + a @ _array(qj, _rows(bj, n))
                if bi != bj:
                    sums[bj] = sums.get(bj, 0.0) + a.T @ _array(qi, _rows(bi, n))
            if len(sums) >= 256:
                yield out()
        yield out()

    def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = sum(np.frombuffer(raw, np.float64) for raw in pdf["w"])
        return pd.DataFrame({"b": [int(key[0])], "w": [w.tobytes()]})

    side = F.broadcast if n * width * 8 <= BROADCAST_BYTES else lambda df: df
    joined = blocks.join(side(columns.select(F.col("b").alias("bi"), F.col("q").alias("qi"))), "bi").join(
        side(columns.select(F.col("b").alias("bj"), F.col("q").alias("qj"))), "bj").select("bi", "bj", "m", "qi", "qj")
    sums = joined.mapInPandas(partial, "b long, w binary")
    return sums.groupBy("b").applyInPandas(total, "b long, w binary")


def _cross(rows: DataFrame, n: int, left: str, right: str) -> np.ndarray:
    """Transposed ``left`` columns times ``right`` columns, added over all blocks on the executors."""

    def partial(batches):
        acc = None
        for pdf in batches:
            for b, x, y in pdf.itertuples(index=False):
                part = _array(x, _rows(b, n)).T @ _array(y, _rows(b, n))
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"c": [acc.shape[1]], "p": [acc.ravel()]})

    parts = rows.select("b", F.col(left).alias("x"), F.col(right).alias("y")).mapInPandas(partial, "c int, p array<double>")
    cells = parts.select("c", F.posexplode("p").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v"))
    got = cells.toPandas().sort_values("at")
    return got["v"].to_numpy().reshape(-1, int(got["c"].iloc[0]))


def _transform(rows: DataFrame, n: int, h: np.ndarray, u: np.ndarray) -> DataFrame:
    """(b, basis, w): ``w`` less its part in the basis, with its columns mixed by ``u``."""

    def run(batches):
        for pdf in batches:
            pdf["w"] = [
                ((_array(w, _rows(b, n)) - _array(q, _rows(b, n)) @ h) @ u).tobytes()
                for b, q, w in zip(pdf["b"], pdf["basis"], pdf["w"])
            ]
            yield pdf[["b", "basis", "w"]]

    return rows.select("b", "basis", "w").mapInPandas(run, "b long, basis binary, w binary")


def _orthonormal(rows: DataFrame, n: int, h: np.ndarray, gram: np.ndarray, floor: float) -> tuple[DataFrame | None, np.ndarray]:
    """``rows`` with ``w`` made orthonormal and orthogonal to the basis, and R with (w less basis part) = new w times R.

    ``h`` and ``gram`` are the products of the basis and of w with w. Three rounds, because a single one leaves a
    rest where columns are nearly dependent. Columns below ``floor`` in length are dropped; None if none is left.
    """
    r = np.eye(gram.shape[0])
    for again in range(3):
        if again:
            h, gram = _cross(rows, n, "basis", "w"), _cross(rows, n, "w", "w")
        s, v = np.linalg.eigh(gram - h.T @ h)
        keep = s > (0.25 if again else floor * floor)
        if not keep.any():
            return None, r
        s, v = s[keep], v[:, keep]
        rows = _transform(rows, n, h, v / np.sqrt(s))
        r = np.sqrt(s)[:, None] * v.T @ r
    return rows, r


def _append(rows: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            pdf["basis"] = [
                np.hstack([_array(q, _rows(b, n)), _array(w, _rows(b, n))]).tobytes()
                for b, q, w in zip(pdf["b"], pdf["basis"], pdf["w"])
            ]
            yield pdf.rename(columns={"w": "q"})[["b", "basis", "q"]]

    return cut(rows.mapInPandas(run, "b long, basis binary, q binary"))


def centred_spectrum(
    blocks: DataFrame, n: int, scale: float, trace: float, wanted: int, width: int = 16, basis: int = 1024,
    tolerance: float = 1e-9, rounds: int = 20, seed: int = 1,
) -> Spectrum:
    """The ``wanted`` largest eigenpairs of J·(scale·M)·J with M in ``blocks`` and J the centring.

    The basis grows by ``width`` columns a step until the residuals are below ``tolerance`` of the largest
    eigenvalue, or nothing new is left; a full basis is started again from the best vectors, ``rounds`` times at
    most, after which not having converged raises. Up to ``basis`` rows the basis takes in the whole space, in
    four or a few more wide steps, and the sum of positive eigenvalues is exact. Elsewhere it is ``trace`` (exact) plus the size of the negative ones, which the steps
    from random signs estimate by quadrature: no error for Euclidean distances, and one in proportion to the
    negative part otherwise.
    """
    spark = blocks.sparkSession
    wanted = min(wanted, n - 1)
    whole = n - 1 <= basis
    width = -(-(n - 1) // 4) if whole else max(width, wanted + 4)

    def first(batches):
        for pdf in batches:
            ones, signs = [], []
            for b in pdf["b"]:
                m = _rows(int(b), n)
                ones.append(np.full((m, 1), n ** -0.5).tobytes())
                signs.append(np.random.default_rng([seed, int(b)]).choice([-1.0, 1.0], (m, width)).tobytes())
            yield pd.DataFrame({"b": pdf["b"], "basis": ones, "w": signs})

    n_blocks = -(-n // BLOCK)
    start = spark.range(0, n_blocks, 1, min(n_blocks, spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "b").mapInPandas(first, "b long, basis binary, w binary")
    positive = None
    for _ in range(rounds):
        rows, r = _orthonormal(start, n, _cross(start, n, "basis", "w"), _cross(start, n, "w", "w"), 1e-6)
        if rows is None:
            break
        state, begin, t, weight = _append(rows, n), 1, np.zeros((0, 0)), r
        while True:
            size = t.shape[0] + r.shape[0]
            product = _multiply(blocks, state.select("b", "q"), n, r.shape[0])
            rows = cut(state.select("b", "basis").join(product, "b"))
            h, gram = _cross(rows, n, "basis", "w") * scale, _cross(rows, n, "w", "w") * scale * scale
            grown = np.zeros((size, size))
            grown[:begin - 1, :begin - 1] = t
            grown[:, begin - 1:], grown[begin - 1:, :] = h[1:], h[1:].T
            t = (grown + grown.T) / 2
            values, y = np.linalg.eigh(t)
            values, y = values[::-1], y[:, ::-1]
            top = np.abs(values).max()
            rest = gram - h.T @ h
            last = y[begin - 1:, :wanted]
            off = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", last, rest, last), 0.0))
            kept, nxt = _orthonormal(rows, n, h / scale, gram / scale / scale, 1e-7 * max(top, 1e-300) / abs(scale))
            exact = kept is None or size >= n - 1
            done = not whole and size >= wanted and (off <= tolerance * top).all()
            if exact or done or size + nxt.shape[0] > basis:
                break
            begin, r, state = 1 + size, nxt, _append(kept, n)
        if positive is None:
            if exact:
                positive = values[values > 0].sum()
            else:
                shares = ((y[:weight.shape[0]].T @ weight) ** 2).mean(axis=1)
                positive = trace + (shares * np.maximum(-values, 0.0)).sum()
        if exact or done:
            found = min(wanted, size)
            mix = np.vstack([np.zeros((1, found)), y[:, :found]])
            return Spectrum(values[:found], _mixed(state, n, mix, "y").select("b", "y"), float(positive), exact)
        start = _restarted(state, n, np.vstack([np.zeros((1, width)), y[:, :width]]))
    else:
        raise ArithmeticError(f"no {wanted} eigenvalues to {tolerance} within {rounds} rounds of {basis} vectors")
    return Spectrum(np.zeros(0), spark.createDataFrame([], "b long, y binary"), 0.0, True)


def _mixed(state: DataFrame, n: int, mix: np.ndarray, name: str) -> DataFrame:
    """(b, basis, ``name``): the basis columns mixed by ``mix``."""

    def run(batches):
        for pdf in batches:
            pdf[name] = [(_array(q, _rows(b, n)) @ mix).tobytes() for b, q in zip(pdf["b"], pdf["basis"])]
            yield pdf[["b", "basis", name]]

    return state.select("b", "basis").mapInPandas(run, f"b long, basis binary, {name} binary")


def _restarted(state: DataFrame, n: int, mix: np.ndarray) -> DataFrame:
    """Ones as the basis again, the mixed columns as the next start."""

    def run(batches):
        for pdf in batches:
            pdf["basis"] = [np.full((_rows(b, n), 1), n ** -0.5).tobytes() for b in pdf["b"]]
            yield pdf[["b", "basis", "w"]]

    return cut(_mixed(state, n, mix, "w").mapInPandas(run, "b long, basis binary, w binary"))
