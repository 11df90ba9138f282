"""Experiment harness: configuration grids, budgets, node samples and runs."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uniform

RESERVED = ("fixed", "grid", "random")


class ConfigError(SystemExit):
    """A configuration that cannot be expanded."""


def flatten(nested: dict, prefix: str = "") -> dict:
    """Nested keys as dotted ones."""
    out: dict = {}
    for key, value in nested.items():
        if isinstance(value, dict) and value:
            out |= flatten(value, f"{prefix}{key}.")
        else:
            out[prefix + key] = value
    return out


def unflatten(flat: dict, levels: int | None = None) -> dict:
    """Dotted keys as nested dictionaries, down to so many levels if given."""
    out: dict = {}
    for key, value in flat.items():
        *path, last = key.split(".", levels) if levels is not None else key.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ConfigError(f"{key}: {p} holds a value and a group")
        at[last] = value
    return out


def merge(a: dict, b: dict) -> dict:
    """b over a, dictionaries in depth."""
    out = dict(a)
    for key, value in b.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def grid_values(spec: dict) -> list:
    """Values of one grid parameter: choice, range, uniform or loguniform."""
    kind = spec["type"]
    if kind == "choice":
        return list(spec["options"])
    if kind == "range":
        lo, hi, step = spec["min"], spec["max"], spec["step"]
        return [lo + i * step for i in range(max(0, int((hi - lo) / step + 1e-9) + ((lo + int((hi - lo) / step + 1e-9) * step) < hi)))]
    if kind in ("uniform", "loguniform"):
        import numpy as np

        make = np.linspace if kind == "uniform" else np.geomspace
        return [float(x) for x in make(spec["min"], spec["max"], spec["num"])]
    raise ConfigError(f"parameter type {kind} cannot be in a grid")


def sample_value(spec: dict, rng: random.Random):
    """A draw of one random parameter: choice, randint, uniform or loguniform."""
    import math

    kind = spec["type"]
    if kind == "choice":
        return rng.choice(list(spec["options"]))
    if kind == "randint":
        return rng.randrange(int(spec["min"]), int(spec["max"]))
    if kind == "uniform":
        return rng.uniform(spec["min"], spec["max"])
    if kind == "loguniform":
        return math.exp(rng.uniform(math.log(spec["min"]), math.log(spec["max"])))
    raise ConfigError(f"parameter type {kind} cannot be random")


def _named(grid: dict, prefix: str = "") -> dict[str, dict]:
    out: dict[str, dict] = {}
    for key, value in grid.items():
        if isinstance(value, dict) and value.get("type") == "parameter_collection":
            out |= _named(value["params"], f"{prefix}{key}.")
        elif isinstance(value, dict) and "type" in value:
            out[prefix + key] = value
        elif isinstance(value, dict):
            out |= _named(value, f"{prefix}{key}.")
        else:
            raise ConfigError(f"{prefix}{key} is no parameter")
    return out


def detect_duplicates(level: dict) -> None:
    """A parameter may be set in one of fixed, grid and random only, and not both as a value and as a group."""
    where: dict[str, str] = {}
    for part in RESERVED:
        values = {k: v for k, v in level.get(part, {}).items() if part != "random" or k not in ("samples", "seed")}
        for key in flatten(values) if part == "fixed" else _named(values):
            if key in where:
                raise ConfigError(f"{key} is in {where[key]} and in {part}")
            where[key] = part
    for key in where:
        if any(other.startswith(key + ".") for other in where):
            raise ConfigError(f"{key} is a value and a group")


def generate_configs(experiment: dict) -> list[dict]:
    """All configurations: each leaf level is merged over its parents, then grids are multiplied and random draws added."""

    def leaves(level: dict, above: dict) -> Iterator[dict]:
        own = merge(above, {k: v for k, v in level.items() if k in RESERVED})
        below = {k: v for k, v in level.items() if k not in RESERVED and isinstance(v, dict)}
        if not below:
            yield own
        for part in below.values():
            yield from leaves(part, own)

    out: list[dict] = []
    for leaf in leaves({k: v for k, v in experiment.items() if k not in ("seml", "slurm")}, {}):
        detect_duplicates(leaf)
        fixed = flatten(leaf.get("fixed", {}))
        grid = {k: grid_values(v) for k, v in _named(leaf.get("grid", {})).items()}
        points = [fixed | dict(zip(grid, p, strict=True)) for p in itertools.product(*grid.values())]
        spec = leaf.get("random")
        if spec:
            rng = random.Random(spec.get("seed", 0))
            draws = _named({k: v for k, v in spec.items() if k not in ("samples", "seed")})
            points = [p | {k: sample_value(v, rng) for k, v in draws.items()} for _ in range(spec["samples"]) for p in points]
        out += [unflatten(p) for p in points]
    unique = {json.dumps(c, sort_keys=True, default=str): c for c in out}
    return list(unique.values())


def read_config(path: str) -> dict:
    """A YAML file as a dictionary; a key that stands twice in one mapping is an error."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        loader.flatten_mapping(node)
        seen = [loader.construct_object(key, deep=True) for key, _ in node.value]
        twice = {k for k in seen if seen.count(k) > 1}
        if twice:
            raise ValueError(f"keys that stand twice: {sorted(map(str, twice))}")
        return loader.construct_mapping(node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    with open(path) as f:
        return yaml.load(f, Strict)


def check_epsilons(epsilons: list[float]) -> list[float]:
    """Budgets as shares: sorted, unique and not negative."""
    if sorted(set(epsilons)) != list(epsilons) or any(e < 0 for e in epsilons):
        raise ValueError("epsilons must be sorted, unique and not negative")
    return list(epsilons)


def budget(epsilon: float, edges: int, undirected: bool = True) -> int:
    """Edges that a share of the graph allows; rounds half to even."""
    return round(epsilon * (edges / 2 if undirected else edges))


def sample_attack_nodes(statistics: DataFrame, edges: DataFrame, top: int, min_degree: int = 1, seed: int = 0) -> DataFrame:
    """(id, kind): the top most and least confident correct nodes of enough degree, and up to 2 * top others by draw.

    Fewer than 4 * top suitable nodes are an error.
    """
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d")).filter(F.col("d") >= min_degree)
    good = statistics.filter("margin > 0").join(degree, "id", "left_semi").select("id", F.round("margin", 9).alias("margin"))
    if good.limit(4 * top).count() < 4 * top:
        raise ValueError(f"fewer than {4 * top} suitable nodes")
    high = good.orderBy(F.col("margin").desc(), "id").limit(top).select("id", F.lit("high").alias("kind"))
    low = good.orderBy("margin", "id").limit(top).select("id", F.lit("low").alias("kind")).join(high.select("id"), "id", "left_anti")
    rest = good.join(high.unionByName(low).select("id"), "id", "left_anti")
    some = rest.orderBy(uniform(seed, "id"), "id").limit(2 * top).select("id", F.lit("random").alias("kind"))
    return high.unionByName(low).unionByName(some)


def run_global(graph, model, split: DataFrame, attack, epsilons: list[float], store=None, label: str = "model", **parameters) -> DataFrame:
    """results(label, epsilon, accuracy): accuracy on the test part after an attack of each budget; perturbed pairs are stored."""
    from ..operators import attacks, losses

    spark = graph.nodes.sparkSession
    m = graph.edges.count()
    test = graph.nodes.join(split.filter("part = 'test'").select("id"), "id", "left_semi")
    rows = []
    for eps in check_epsilons(epsilons):
        n = budget(eps, m)
        key = {"label": label, "epsilon": eps, "attack": attack.__name__, **parameters}
        edges = graph.edges
        if n:
            pairs = store.load("perturbation", key, spark) if store else None
            if pairs is None:
                pairs = attack(graph.edges, graph.nodes, model, test, n, **parameters).pairs
                if store:
                    store.save("perturbation", key, pairs)
            edges = attacks._flip(graph.edges, pairs)
        z = attacks.long_logits(attacks.surrogate_logits(edges, graph.nodes, model))
        rows.append((label, float(eps), float(losses.accuracy(z, test).first().accuracy)))
    return spark.createDataFrame(rows, "label string, epsilon double, accuracy double")


def model_logits(model, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Long logits(id, class, z) of an attackable model, or of a callable of (edges, nodes) that gives (id, k, v)."""
    from ..operators import attacks

    if callable(model):
        return model(edges, nodes).select("id", F.col("k").alias("class"), F.col("v").alias("z"))
    return attacks.long_logits(attacks.surrogate_logits(edges, nodes, model))


def run_transfer(graph, surrogate, victims: dict, split: DataFrame, attack, epsilons: list[float], store=None, **parameters) -> DataFrame:
    """results(label, epsilon, accuracy): pairs found on the surrogate, judged on every victim (label: model or callable) on the test part.

    Victims need no gradients, so that robust and PPR models can stand here by their forward passes.
    """
    from ..operators import attacks, losses

    m = graph.edges.count()
    test = graph.nodes.join(split.filter("part = 'test'").select("id"), "id", "left_semi")
    rows = []
    for eps in check_epsilons(epsilons):
        n, edges = budget(eps, m), graph.edges
        if n:
            key = {"surrogate": type(surrogate).__name__, "epsilon": eps, "attack": attack.__name__, **parameters}
            pairs = store.load("perturbation", key, graph.nodes.sparkSession) if store else None
            if pairs is None:
                pairs = attack(graph.edges, graph.nodes, surrogate, test, n, **parameters).pairs
                if store:
                    store.save("perturbation", key, pairs)
            edges = attacks._flip(graph.edges, pairs)
        for label, victim in victims.items():
            rows.append((label, float(eps), float(losses.accuracy(model_logits(victim, edges, graph.nodes), test).first().accuracy)))
    return graph.nodes.sparkSession.createDataFrame(rows, "label string, epsilon double, accuracy double")


def train_model(graph, split: DataFrame, store=None, key: dict | None = None, **parameters):
    """(model, row): a GCN fitted on the train part (two layers, or more by the widths in `hidden`), and its accuracy on all three parts; the weights are saved under key and parameters."""
    from ..operators import attacks, losses, models

    params = {**(key or {}), **parameters}
    weights = store.load_model(params) if store else None
    if weights is None:
        weights, _ = models.train_gcn(graph.edges, graph.nodes, split, **parameters)
        if store:
            store.save_model(params, weights)
    model = attacks.Gcn([np.asarray(weights[k]) for k in sorted(weights, key=lambda k: int(k[1:]))])
    found = losses.accuracy(model_logits(model, graph.edges, graph.nodes), graph.nodes, split)
    return model, {r.part: r.accuracy for r in found.collect()}


def run_poisoning(graph, surrogate, split: DataFrame, attack, epsilons: list[float], attack_parameters: dict | None = None, **parameters) -> DataFrame:
    """results(epsilon, part, accuracy): the model is trained anew on each perturbed graph."""
    from ..operators import attacks

    m = graph.edges.count()
    test = graph.nodes.join(split.filter("part = 'test'").select("id"), "id", "left_semi")
    rows = []
    for eps in check_epsilons(epsilons):
        n = budget(eps, m)
        edges = attacks._flip(graph.edges, attack(graph.edges, graph.nodes, surrogate, test, n, **(attack_parameters or {})).pairs) if n else graph.edges
        _, found = train_model(graph.with_edges(edges), split, **parameters)
        rows += [(float(eps), part, float(a)) for part, a in found.items()]
    return graph.nodes.sparkSession.createDataFrame(rows, "epsilon double, part string, accuracy double")


def node_logits(model, edges: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """Long logits(id, class, z) of one node: of an attackable model, a PageRank model (its row computed anew), or a callable of (edges, nodes)."""
    from ..operators.ppr_attacks import PprVictim, exact_logits

    if isinstance(model, PprVictim):
        z = exact_logits(edges, model, node)
        return edges.sparkSession.createDataFrame([(node, c, float(v)) for c, v in enumerate(z)], "id long, class int, z double")
    return model_logits(model, edges, nodes).filter(F.col("id") == node)


LOCAL = "label string, epsilon double, n_perturbations int, degree long, node_id long, target int, perturbed_edges array<array<long>>, logit_target double, logit_best_non_target double, margin double, initial_margin double"


def _local_attacks(graph, model, nodes: list[int], attack, epsilons: list[float], **parameters):
    """Yields (node, its row, degree, epsilon, budget, result) of an attack on each node with each budget of one edge or more."""
    for node in nodes:
        target = graph.nodes.filter(F.col("id") == node)
        degree = graph.edges.filter(F.col("src") == node).count()
        for eps in check_epsilons(epsilons):
            n = int(eps * degree)
            if n:
                yield node, target, degree, eps, n, attack(graph.edges, graph.nodes, model, node, n, **parameters)


def _local_row(label: str, eps: float, n: int, degree: int, node: int, result, found, clean) -> tuple:
    pairs = [[r.src, r.dst] for r in result.pairs.collect()]
    return (label, float(eps), n, degree, node, clean.label, pairs, found.logit_target, found.logit_best_non_target, found.margin, clean.margin)


def run_local(graph, model, nodes: list[int], attack, epsilons: list[float], label: str = "model", **parameters) -> DataFrame:
    """One row a node and budget with degree, perturbed edges, logits and margins before and after."""
    return run_local_transfer(graph, model, {label: model}, nodes, attack, epsilons, **parameters)


def run_local_transfer(graph, surrogate, victims: dict, nodes: list[int], attack, epsilons: list[float], **parameters) -> DataFrame:
    """Rows as of run_local for every victim (label: model, PageRank model or callable): the edges are found on the surrogate, the margins are the victim's."""
    from ..operators import losses

    rows, clean = [], {}
    for node, target, degree, eps, n, result in _local_attacks(graph, surrogate, nodes, attack, epsilons, **parameters):
        for label, victim in victims.items():
            if (label, node) not in clean:
                clean[label, node] = losses.classification_statistics(node_logits(victim, graph.edges, graph.nodes, node), target).first()
            found = losses.classification_statistics(node_logits(victim, result.edges, graph.nodes, node), target).first()
            rows.append(_local_row(label, eps, n, degree, node, result, found, clean[label, node]))
    return graph.nodes.sparkSession.createDataFrame(rows, LOCAL)


def run_local_poisoning(graph, surrogate, split: DataFrame, nodes: list[int], attack, epsilons: list[float], attack_parameters: dict | None = None, label: str = "poisoned", **parameters) -> DataFrame:
    """Rows as of run_local, of a GCN that is trained anew on the graph with each node's perturbed edges; the first margin is that of the one trained on the clean graph."""
    from ..operators import losses

    rows, clean = [], {}
    before, _ = train_model(graph, split, **parameters)
    for node, target, degree, eps, n, result in _local_attacks(graph, surrogate, nodes, attack, epsilons, **(attack_parameters or {})):
        if node not in clean:
            clean[node] = losses.classification_statistics(node_logits(before, graph.edges, graph.nodes, node), target).first()
        model, _ = train_model(graph.with_edges(result.edges), split, **parameters)
        found = losses.classification_statistics(node_logits(model, result.edges, graph.nodes, node), target).first()
        rows.append(_local_row(label, eps, n, degree, node, result, found, clean[node]))
    return graph.nodes.sparkSession.createDataFrame(rows, LOCAL)


def cache_ppr(edges: DataFrame, split: DataFrame, path: str, alpha: float = 0.1, topk: int = 64, rounds: int | None = None, norm: str = "row", dataset: str = "graph") -> None:
    """Writes the top-k PPR rows of each part of split(id, part) under its own partition."""
    from ..operators import normalize, ppr
    from ..sources.shards import write_ppr

    degrees = normalize.degree(edges)
    for (part,) in split.select("part").distinct().orderBy("part").collect():
        seeds = split.filter(F.col("part") == part)
        scores = ppr.top_k_rows(ppr.power_series(normalize.row(edges), seeds, alpha, rounds), topk)
        write_ppr(ppr.normalized(scores, degrees, norm), path, dataset=dataset, split=part, alpha=alpha, topk=topk, norm=norm)


def write_results(results: DataFrame, folder: str) -> str:
    """JSON lines in a folder of its own under `folder`."""
    import uuid

    path = f"{folder}/{uuid.uuid4().hex}"
    results.write.json(path)
    return path


def run_configs(files: list[str], run) -> list:
    """Calls run(**config) for every distinct configuration of the files."""
    configs = [c for f in files for c in generate_configs(read_config(f))]
    unique = {json.dumps(c, sort_keys=True, default=str): c for c in configs}
    return [run(**c) for c in unique.values()]
