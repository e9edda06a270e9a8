"""Binary Bayesian networks as tables: parents (node, parent, pos), cpt (node, config, p), evidence (scenario, node, value).

Marginals are computed level by level for all scenarios at once, under independence of a node's parents. Evidence
overrides a node and acts downwards only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import cut, numbered
from leafloom.functions.scores import clamp, configurations, log_odds_pool, logit, noisy_or, scaled_sum, sigmoid
from leafloom.operators.graphs import levels

EPS = 1e-6


def without_groups(nodes: DataFrame, edges: DataFrame, tag: str = "group") -> tuple[DataFrame, DataFrame]:
    kept = nodes.filter(F.coalesce("tag", F.lit("")) != tag)
    ids = kept.select("node_id")
    return kept, edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def parent_positions(edges: DataFrame) -> DataFrame:
    """(node, parent, pos), parents in order of their ids."""
    w = Window.partitionBy("dst").orderBy("src")
    return edges.distinct().select(F.col("dst").alias("node"), F.col("src").alias("parent"), (F.row_number().over(w) - 1).alias("pos"))


def initial_cpt(nodes: DataFrame, parents: DataFrame, most_parents: int = 5, low: float = 0.1, high: float = 0.9, seed: int = 42) -> DataFrame:
    """(node, config, p) with uniform random p by a hash of node and config; drugs 0. Nodes of more parents have none."""
    n = nodes.select(F.col("node_id").alias("node"), "tag").join(parents.groupBy("node").agg(F.count("*").alias("k")), "node", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    keys = F.create_map(*[x for k in range(most_parents + 1) for x in (F.lit(k), F.array(*[F.lit(c) for c in configurations(k)]))])
    rows = n.filter(F.col("k") <= most_parents).select("node", "tag", F.explode(F.element_at(keys, F.col("k").cast("int"))).alias("config"))
    random = F.pmod(F.xxhash64("node", "config", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    return rows.select("node", "config", F.when(F.col("tag") == "prepare", 0.0).otherwise(low + random * (high - low)).alias("p"))


def normalise_cpt(cpt: DataFrame) -> DataFrame:
    """Every node's values divided by their sum over the parents' states, roots excepted (a quirk kept as an option)."""
    total = F.sum("p").over(Window.partitionBy("node"))
    return cpt.select("node", "config", F.when((F.col("config") == "") | (total == 0), F.col("p")).otherwise(F.col("p") / total).alias("p"))


def set_doses(cpt: DataFrame, doses: DataFrame) -> DataFrame:
    """All values of a node replaced by its dose."""
    return cpt.join(doses.select("node", "dose"), "node", "left").select("node", "config", F.coalesce("dose", "p").alias("p"))


def conditional(cpt: DataFrame, wanted: DataFrame) -> DataFrame:
    """p of each wanted (node, config), 0 where the table lacks it."""
    return wanted.join(cpt, ["node", "config"], "left").select("node", "config", F.coalesce("p", F.lit(0.0)).alias("p"))


def marginals(nodes: DataFrame, parents: DataFrame, cpt: DataFrame, evidence: DataFrame | None = None, most_parents: int = 5, scenarios: DataFrame | None = None) -> DataFrame:
    """(scenario, node, p) of every node. ``evidence`` (scenario, node, value); without scenarios there is one, 0.

    A level is one plan: parents' states from the bits of the table's keys, products and sums by exp and log of clamped
    values. Nodes of more than ``most_parents`` parents take the product of these.
    """
    edges = parents.select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    level, acyclic = levels(nodes, edges)
    if not acyclic:
        raise ValueError("the graph has a cycle")
    level = cut(level.withColumnRenamed("node_id", "node"))
    depth = level.agg(F.max("level")).first()[0]
    if depth is None:
        return nodes.sparkSession.createDataFrame([], "scenario bigint, node string, p double")
    if scenarios is None:
        scenarios = evidence.select("scenario").distinct() if evidence is not None else nodes.sparkSession.range(1).select(F.col("id").alias("scenario"))
    given = evidence.select("scenario", "node", clamp(F.col("value"), 0.0, 1.0).alias("value")) if evidence is not None else None
    bits = F.split("config", ",")
    states = cpt.filter("config <> ''").select("node", "config", F.col("p").alias("pc"), F.posexplode(bits).alias("pos", "state"))
    states = cut(states.join(parents, ["node", "pos"]))
    wide = parents.groupBy("node").agg(F.count("*").alias("k")).filter(F.col("k") > most_parents).select("node")
    roots = level.filter("level = 0").join(cpt.filter("config = ''"), "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))

    def with_evidence(rows: DataFrame) -> DataFrame:
        if given is None:
            return rows
        return rows.join(given, ["scenario", "node"], "left").select("scenario", "node", F.coalesce("value", "p").alias("p"))

    done = cut(with_evidence(scenarios.crossJoin(roots)))
    for at in range(1, depth + 1):
        here = level.filter(F.col("level") == at).select("node")
        known = done.select("scenario", F.col("node").alias("parent"), clamp(F.col("p"), EPS, 1 - EPS).alias("q"))
        tables = states.join(here, "node", "left_semi").join(wide, "node", "left_anti")
        value = F.log(F.when(F.col("state") == "1", F.col("q")).otherwise(1 - F.col("q")))
        mixed = tables.join(known, "parent").groupBy("scenario", "node", "config", "pc").agg(F.exp(F.sum(value)).alias("w"))
        narrow = mixed.groupBy("scenario", "node").agg(F.sum(F.col("w") * F.col("pc")).alias("p"))
        broad = parents.join(wide, "node", "left_semi").join(here, "node", "left_semi").join(known, "parent").groupBy("scenario", "node").agg(F.exp(F.sum(F.log("q"))).alias("p"))
        all_ = scenarios.crossJoin(here).join(narrow.unionByName(broad), ["scenario", "node"], "left").select("scenario", "node", F.coalesce("p", F.lit(0.0)).alias("p"))
        done = cut(done.unionByName(with_evidence(all_)))
    return done


def pooled_targets(scenarios: DataFrame, targets: DataFrame, how: str = "log_odds", scale: float = 3.0) -> DataFrame:
    """(scenario, effect, target) of scenarios (scenario, drug) from targets (drug, effect, prob)."""
    pool = {"log_odds": lambda p: log_odds_pool(p), "noisy_or": lambda p: noisy_or(p), "scaled_sum": lambda p: scaled_sum(p, scale), "capped_sum": lambda p: F.least(F.sum(p), F.lit(1.0))}[how]
    return scenarios.join(targets, "drug").groupBy("scenario", "effect").agg(pool(F.col("prob")).alias("target"))


def scenario_loss(probabilities: DataFrame, targets: DataFrame, weighted: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(loss, n_scenarios): squared errors of (scenario, node, p) against (scenario, effect, target), summed.

    ``weighted`` divides by the root of a scenario's number of drugs and by the sum of these weights.
    """
    per = probabilities.join(targets.withColumnRenamed("effect", "node"), ["scenario", "node"]).groupBy("scenario").agg(F.sum(F.pow(F.col("p") - F.col("target"), 2)).alias("se"))
    if weighted:
        per = per.join(sizes, "scenario").withColumn("w", 1 / F.sqrt("n_drugs"))
        return per.agg(F.try_divide(F.sum(F.col("w") * F.col("se")), F.sum("w")).alias("loss"), F.count("*").alias("n_scenarios"))
    return per.agg(F.sum("se").alias("loss"), F.count("*").alias("n_scenarios"))


def drug_scenarios(drugs: DataFrame, most: int = 2, per_size: int | None = None, least_per_size: int | None = None, seed: int = 42) -> DataFrame:
    """(scenario, drug, n_drugs): all sets of 1 to ``most`` drugs; per size at most ``per_size``, repeated up to the least."""
    one = drugs.select(F.array("drug").alias("set"))
    every, last = one, one
    for _ in range(most - 1):
        last = last.join(drugs, drugs["drug"] > F.element_at("set", -1)).select(F.concat("set", F.array("drug")).alias("set"))
        every = every.unionByName(last)
    sets = every.withColumn("n_drugs", F.size("set"))
    if per_size is not None:
        w = Window.partitionBy("n_drugs").orderBy(F.xxhash64("set", F.lit(seed)), "set")
        sets = sets.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_size).drop("r")
    if least_per_size is not None:
        n = sets.groupBy("n_drugs").agg(F.count("*").alias("have"))
        sets = sets.join(n, "n_drugs").select("set", "n_drugs", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.lit(least_per_size) / F.col("have")), F.lit(1)).cast("int"))).alias("copy"))
    else:
        sets = sets.withColumn("copy", F.lit(1))
    return sets.select(F.xxhash64("set", "copy").alias("scenario"), F.explode("set").alias("drug"), "n_drugs")


def pair_loss(targets: DataFrame, against: float) -> DataFrame:
    """(n_scenarios, loss): squared errors of the log-odds targets of every drug and every pair of drugs, summed.

    As ``pooled_targets`` of ``drug_scenarios(drugs, 2)`` has them, but counted by effect and value, so no pair of drugs is
    made: a pair without the effect in one drug pools as the other alone. ``targets`` (drug, effect, prob) has a row a pair.
    """
    value = targets.groupBy("effect", "prob").agg(F.count("*").alias("n")).withColumn("x", logit(F.col("prob")))
    having = targets.groupBy("effect").agg(F.count("*").alias("n_effect"))
    drugs = targets.agg(F.count_distinct("drug").alias("d"))
    error = lambda x: F.pow(sigmoid(x) - against, 2)
    # alone, and with each drug that lacks the effect
    one = value.join(having, "effect").crossJoin(drugs).select((F.col("n") * (1 + F.col("d") - F.col("n_effect")) * error(F.col("x"))).alias("se"))
    b = value.select("effect", F.col("prob").alias("prob2"), F.col("n").alias("n2"), F.col("x").alias("x2"))
    times = F.when(F.col("prob") == F.col("prob2"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2"))
    two = value.join(b, "effect").filter("prob <= prob2").select((times * error(F.col("x") + F.col("x2"))).alias("se"))
    loss = one.unionByName(two).agg(F.sum("se").alias("loss"))
    return drugs.select(F.expr("d + d * (d - 1) div 2").alias("n_scenarios")).crossJoin(loss)


def pinned_entries(cpt: DataFrame, parents: DataFrame, drugs: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``pinned``: entries of effects with an active drug parent that has a target value."""
    states = cpt.filter("config <> ''").select("node", "config", F.posexplode(F.split("config", ",")).alias("pos", "state")).filter("state = '1'")
    known = states.join(parents, ["node", "pos"]).join(drugs.select(F.col("drug").alias("parent")), "parent", "left_semi").join(targets.select(F.col("drug").alias("parent"), F.col("effect").alias("node")), ["parent", "node"], "left_semi")
    hit = known.select("node", "config").distinct().withColumn("pinned", F.lit(True))
    return cpt.join(hit, ["node", "config"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def parameter_vector(cpt: DataFrame) -> DataFrame:
    """(param_id, node, config, p), numbered from 0 by node and config; ``p`` to six places."""
    rows = numbered(cpt.select("node", "config", F.round("p", 6).alias("p")), ["node", "config"])
    return rows.select((F.col("rank") - 1).cast("int").alias("param_id"), "node", "config", "p")


def export_cpt(cpt: DataFrame) -> DataFrame:
    """(node, table): the values of each node by config, to six places, as JSON."""
    return cpt.groupBy("node").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", F.round("p", 6)))))).alias("table"))


def combination_result(probabilities: DataFrame, states: DataFrame) -> DataFrame:
    """(scenario, description, node, p) where the description lists the drug states as "a=1 + b=0"."""
    text = states.groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_list(F.concat("drug", F.lit("="), F.col("state").cast("string")))), " + ").alias("description"))
    return probabilities.join(text, "scenario").select("scenario", "description", "node", "p")


def folds(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))


def with_parameters(cpt: DataFrame, vector: DataFrame) -> DataFrame:
    """The tables with the values of a parameter vector (node, config, p), as ``parameter_vector`` numbers them."""
    new = vector.select("node", "config", F.col("p").alias("__p"))
    return cpt.join(new, ["node", "config"], "left").select("node", "config", F.coalesce("__p", "p").alias("p"))


#: Most entries of tables that are fitted on the driver; larger networks are refused.
MOST_PARAMETERS = 200_000


class Network:
    """A network small enough for the driver, for fitting: values and gradients in NumPy, by level."""

    def __init__(self, nodes: DataFrame, parents: DataFrame, cpt: DataFrame, most_parents: int = 5) -> None:
        size = cpt.count() + nodes.count() + parents.count()
        if size > MOST_PARAMETERS:
            raise ValueError(f"{size} entries do not fit the driver (at most {MOST_PARAMETERS})")
        order, acyclic = levels(nodes, parents.select(F.col("parent").alias("src"), F.col("node").alias("dst")))
        if not acyclic:
            raise ValueError("the graph has a cycle")
        self.nodes = [r.node_id for r in order.orderBy("level", "node_id").collect()]
        at = {n: i for i, n in enumerate(self.nodes)}
        self.parents: list[list[int]] = [[] for _ in self.nodes]
        for r in parents.orderBy("node", "pos").collect():
            self.parents[at[r.node]].append(at[r.parent])
        self.tables = [np.full(2 ** len(p) if len(p) <= most_parents else 0, 0.5) for p in self.parents]
        for r in cpt.collect():
            i = at.get(r.node)
            if i is not None and len(self.tables[i]):
                self.tables[i][int(r.config.replace(",", "") or "0", 2)] = r.p
        self.at, self.most = at, most_parents
        #: Parents left out of a round of training: their state counts as unknown.
        self.dropped: set[tuple[int, int]] = set()

    def _states(self, p: np.ndarray, i: int) -> np.ndarray:
        """The values of a node's parents, one half for those dropped."""
        v = np.clip(p[:, self.parents[i]], EPS, 1 - EPS)
        for j, q in enumerate(self.parents[i]):
            if (i, q) in self.dropped:
                v[:, j] = 0.5
        return v

    @staticmethod
    def _weights(v: np.ndarray) -> np.ndarray:
        """The probability of every combination of states, the first parent the highest bit."""
        w = np.ones((len(v), 1))
        for j in range(v.shape[1]):
            w = np.stack([w * (1 - v[:, [j]]), w * v[:, [j]]], axis=2).reshape(len(v), -1)
        return w

    def forward(self, evidence: np.ndarray) -> np.ndarray:
        """Marginals of every scenario (rows); -1 in ``evidence`` means unknown."""
        p = np.zeros_like(evidence)
        for i in range(len(self.nodes)):
            v = self._states(p, i)
            p[:, i] = self._weights(v) @ self.tables[i] if len(self.tables[i]) else np.prod(v, axis=1)
            seen = evidence[:, i] >= 0
            p[seen, i] = evidence[seen, i]
        return p

    def loss(self, evidence: np.ndarray, targets: np.ndarray) -> float:
        """Sum of squared errors where ``targets`` is not NaN."""
        return float(np.nansum((self.forward(evidence) - targets) ** 2))

    def gradient(self, evidence: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss and its gradient by every table."""
        p = self.forward(evidence)
        error = np.nan_to_num(p - targets)
        back, grads = 2 * error, [np.zeros_like(t) for t in self.tables]
        for i in range(len(self.nodes) - 1, -1, -1):
            g = np.where(evidence[:, i] >= 0, 0.0, back[:, i])
            v = self._states(p, i)
            if len(self.tables[i]):
                grads[i] = self._weights(v).T @ g
            for j, q in enumerate(self.parents[i]):
                if (i, q) in self.dropped:
                    continue
                if len(self.tables[i]):
                    t = self.tables[i].reshape([2] * len(self.parents[i]))
                    slope = self._weights(np.delete(v, j, axis=1)) @ (np.take(t, 1, axis=j) - np.take(t, 0, axis=j)).reshape(-1)
                else:
                    slope = p[:, i] / v[:, j]
                back[:, q] += g * slope
        return float((error**2).sum()), grads

    def numeric_gradient(self, evidence: np.ndarray, targets: np.ndarray, h: float = 1e-6) -> list[np.ndarray]:
        """Central differences of the loss by every entry."""
        out = [np.zeros_like(t) for t in self.tables]
        for table, slope in zip(self.tables, out):
            for k in range(len(table)):
                kept = table[k]
                sides = []
                for step in (h, -h):
                    table[k] = kept + step
                    sides.append(self.loss(evidence, targets))
                table[k] = kept
                slope[k] = (sides[0] - sides[1]) / (2 * h)
        return out

    def fit_numeric(self, evidence: np.ndarray, targets: np.ndarray, steps: int = 20, rate: float = 0.05, low: float = 0.01, high: float = 0.99) -> list[float]:
        """Gradient descent by finite differences, values clipped to their bounds; the losses by step."""
        losses = [self.loss(evidence, targets)]
        for _ in range(steps):
            grads = self.numeric_gradient(evidence, targets)
            self.tables = [np.clip(t - rate * g, low, high) for t, g in zip(self.tables, grads)]
            losses.append(self.loss(evidence, targets))
        return losses

    def fit(
        self, evidence: np.ndarray, targets: np.ndarray, epochs: int = 150, rate: float = 0.07, decay: float = 0.0, fixed: list[np.ndarray] | None = None, patience: int | None = None,
        schedule: str = "cosine", rectified: bool = False, prior: float = 0.0, drop_entries: float = 0.0, drop_parents: float = 0.0, seed: int = 42,
    ) -> list[float]:
        """Adam on logits with clipped gradients; the losses by epoch.

        ``decay`` is the weight decay of AdamW, ``rectified`` its start with a corrected variance (RAdam). The rate follows
        ``schedule``: cosine, exponential, or plateau (halved when five epochs bring nothing). ``prior`` draws the values to
        those at the start; ``drop_entries`` and ``drop_parents`` leave out a share of both in every epoch.
        """
        rng = np.random.default_rng(seed)
        logit_ = lambda t: np.log(np.clip(t, EPS, 1 - EPS) / (1 - np.clip(t, EPS, 1 - EPS)))
        start = [t.copy() for t in self.tables]
        z = [logit_(t) for t in self.tables]
        m, v, losses, best, since, slower = [np.zeros_like(x) for x in z], [np.zeros_like(x) for x in z], [], np.inf, 0, 1.0
        links = [(i, q) for i, ps in enumerate(self.parents) for q in ps]
        for epoch in range(1, epochs + 1):
            self.tables = [1 / (1 + np.exp(-x)) for x in z]
            self.dropped = {link for link in links if rng.random() < drop_parents} if drop_parents else set()
            loss, grads = self.gradient(evidence, targets)
            if prior:
                loss += prior * sum(((t - s) ** 2).sum() for t, s in zip(self.tables, start))
                grads = [g + 2 * prior * (t - s) for g, t, s in zip(grads, self.tables, start)]
            losses.append(loss)
            best, since = (loss, 0) if loss < best - 1e-9 else (best, since + 1)
            if patience is not None and since > patience:
                break
            if schedule == "plateau" and since and since % 5 == 0:
                slower /= 2
            grads = [g * t * (1 - t) for g, t in zip(grads, self.tables)]
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            lr = rate * {"cosine": (1 + np.cos(np.pi * epoch / epochs)) / 2, "exponential": 0.97**epoch, "plateau": slower}[schedule]
            last = 2 / (1 - 0.999) - 1
            length = last - 2 * epoch * 0.999**epoch / (1 - 0.999**epoch)
            for i, g in enumerate(grads):
                g = g * min(1.0, 1 / max(norm, 1e-12))
                if fixed is not None:
                    g = np.where(fixed[i], 0.0, g)
                if drop_entries:
                    g = np.where(rng.random(g.shape) < drop_entries, 0.0, g)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                step = m[i] / (1 - 0.9**epoch)
                if not rectified:
                    step = step / (np.sqrt(v[i] / (1 - 0.999**epoch)) + 1e-8)
                elif length > 4:
                    r = np.sqrt((length - 4) * (length - 2) * last / ((last - 4) * (last - 2) * length))
                    step = r * step / (np.sqrt(v[i] / (1 - 0.999**epoch)) + 1e-8)
                held = np.zeros(g.shape, bool) if fixed is None else fixed[i]
                z[i] = np.where(held, z[i], z[i] - lr * (step + decay * z[i]))
        self.tables, self.dropped = [1 / (1 + np.exp(-x)) for x in z], set()
        return losses

    def fit_projected(self, evidence: np.ndarray, targets: np.ndarray, steps: int = 100, rate: float = 0.05, low: float = 1e-5, high: float = 1 - 1e-7) -> list[float]:
        """Gradient descent on the probabilities themselves, kept within bounds; the step halves when the loss rises."""
        losses = [self.gradient(evidence, targets)[0]]
        for _ in range(steps):
            _, grads = self.gradient(evidence, targets)
            old = [t.copy() for t in self.tables]
            self.tables = [np.clip(t - rate * g, low, high) for t, g in zip(self.tables, grads)]
            loss = self.gradient(evidence, targets)[0]
            if loss > losses[-1]:
                self.tables, rate = old, rate / 2
            else:
                losses.append(loss)
        return losses

    def fit_quasi_newton(self, evidence: np.ndarray, targets: np.ndarray, steps: int = 100, memory: int = 10, low: float = 1e-5, high: float = 0.9999999, tolerance: float = 1e-10) -> list[float]:
        """Limited-memory BFGS within bounds: entries held at a bound by the gradient leave the step, which is projected back.

        The losses of the accepted steps; they never rise.
        """
        cuts = np.cumsum([len(t) for t in self.tables])[:-1]
        flat = lambda parts: np.concatenate(parts)

        def at(x: np.ndarray) -> tuple[float, np.ndarray]:
            self.tables = np.split(x, cuts)
            loss, grads = self.gradient(evidence, targets)
            return loss, flat(grads)

        x = np.clip(flat(self.tables), low, high)
        loss, g = at(x)
        losses, pairs = [loss], []
        for _ in range(steps):
            free = ~((x <= low) & (g > 0) | (x >= high) & (g < 0))
            q, used = np.where(free, g, 0.0), []
            for s, y, r in reversed(pairs):
                a = r * (s @ q)
                q = q - a * y
                used.append(a)
            if pairs:
                s, y, _ = pairs[-1]
                q = q * ((s @ y) / (y @ y))
            for (s, y, r), a in zip(pairs, reversed(used)):
                q = q + s * (a - r * (y @ q))
            direction = -np.where(free, q, 0.0)
            if direction @ g >= 0:
                direction, pairs = -np.where(free, g, 0.0), []
            size = 1.0
            while size > 1e-12:
                new = np.clip(x + size * direction, low, high)
                tried, slope = at(new)
                if tried <= loss + 1e-4 * (g @ (new - x)):
                    break
                size /= 2
            else:
                break
            s, y = new - x, slope - g
            if s @ y > 1e-14:
                pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
            done = loss - tried <= tolerance * max(loss, 1e-12)
            x, loss, g = new, tried, slope
            losses.append(loss)
            if done:
                break
        at(x)
        return losses


def cross_validate(network: Network, evidence: np.ndarray, targets: np.ndarray, fold: np.ndarray, **fit) -> list[tuple[int, float, float]]:
    """(fold, loss before, loss after) on the scenarios of each fold after a fit to all others; the tables stay as they were."""
    start, out = [t.copy() for t in network.tables], []
    for k in np.unique(fold):
        held = fold == k
        network.tables = [t.copy() for t in start]
        before = network.loss(evidence[held], targets[held])
        network.fit(evidence[~held], targets[~held], **fit)
        out.append((int(k), before, network.loss(evidence[held], targets[held])))
    network.tables = start
    return out
