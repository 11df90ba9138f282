"""Artifact store: documents of parameters beside Parquet tables or JSON values.

Every document is one small JSON file named by the digest of its kind and parameters, put in
place by an atomic rename, so concurrent writers of different parameters never meet and
writers of the same parameters replace one another. Documents are found by a Spark scan.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=str)


def digest(kind: str, params: dict) -> str:
    return hashlib.md5(f"{kind}:{canonical(params)}".encode()).hexdigest()


def id_fingerprint(ids: DataFrame, column: str = "id") -> str:
    """A digest of a set of ids that does not depend on their order; sums of hashes, so nothing is gathered."""
    row = ids.select(column).distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64(column).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.md5(f"{row.n}:{row.s}".encode()).hexdigest()


class Store:
    """A folder with documents (index) and tables (data)."""

    def __init__(self, root: str) -> None:
        self.root = root
        os.makedirs(f"{root}/index", exist_ok=True)

    def _document(self, kind: str, key: str) -> str:
        return f"{self.root}/index/{kind}-{key}.json"

    def _put(self, kind: str, params: dict, **more) -> str:
        key = digest(kind, params)
        document = {"kind": kind, "id": key, "params": params, "time": time.strftime("%Y-%m-%dT%H:%M:%S"), "order": time.time_ns(), **more}
        temporary = f"{self.root}/index/.{uuid.uuid4().hex}"
        with open(temporary, "w") as f:
            json.dump(document, f, default=str)
        os.replace(temporary, self._document(kind, key))
        return key

    def save(self, kind: str, params: dict, value) -> str:
        """Saves a JSON value or a table under exact parameters; an older one is replaced."""
        if isinstance(value, DataFrame):
            path = f"{self.root}/data/{kind}-{digest(kind, params)}-{uuid.uuid4().hex[:8]}"
            value.write.parquet(path)
            return self._put(kind, params, table=path)
        return self._put(kind, params, value=value)

    def save_table(self, kind: str, params: dict, value: DataFrame, ignore_duplicate: bool = False) -> str | None:
        """Saves a table; an existing one is kept and None returned if duplicates are ignored."""
        if ignore_duplicate and os.path.exists(self._document(kind, digest(kind, params))):
            return None
        return self.save(kind, params, value)

    def _value(self, spark: SparkSession | None, document: dict):
        return spark.read.parquet(document["table"]) if "table" in document else document["value"]

    def load(self, kind: str, params: dict, spark: SparkSession | None = None, with_params: bool = False):
        """The value saved under exactly these parameters, or None."""
        path = self._document(kind, digest(kind, params))
        if not os.path.exists(path):
            return None
        with open(path) as f:
            document = json.load(f)
        value = self._value(spark, document)
        return (value, document["params"]) if with_params else value

    def documents(self, spark: SparkSession, kind: str) -> DataFrame:
        """All documents of a kind as a table (id, params, order, document)."""
        schema = "kind string, id string, order long, table string"
        paths = f"{self.root}/index/{kind}-*.json"
        raw = spark.read.text(paths, wholetext=True) if any(n.startswith(f"{kind}-") for n in os.listdir(f"{self.root}/index")) else spark.createDataFrame([], "value string")
        found = raw.select(F.from_json("value", schema).alias("d"), F.get_json_object("value", "$.params").alias("params"), F.col("value").alias("document"))
        return found.select("d.*", "params", "document").filter(F.col("kind") == kind)

    def find(self, spark: SparkSession, kind: str, match: dict, first: bool = False, documents_only: bool = False) -> list:
        """Artifacts whose parameters contain match, newest first; an empty match finds all."""
        found = self.documents(spark, kind)
        for key, value in match.items():
            stored = F.get_json_object("params", f"$['{key}']")
            want = json.dumps(value, separators=(",", ":")) if isinstance(value, dict | list) else value if isinstance(value, str) else json.dumps(value)
            found = found.filter(stored.isNull() if value is None else stored == want)
        found = found.orderBy(F.col("order").desc(), F.col("id").desc())
        documents = [json.loads(r.document) for r in (found.limit(1) if first else found).collect()]
        return documents if documents_only else [(self._value(spark, d), d["params"]) for d in documents]

    def save_model(self, params: dict, weights: dict) -> str:
        """Saves named weight arrays under exact parameters."""
        return self.save("model", params, {k: {"shape": list(np.shape(v)), "values": np.ravel(v).tolist()} for k, v in weights.items()})

    def load_model(self, params: dict) -> dict | None:
        return self._arrays(self.load("model", params))

    def find_models(self, spark: SparkSession, match: dict) -> list:
        """(weights, parameters) of the models whose parameters contain match, newest first."""
        return [(self._arrays(v), p) for v, p in self.find(spark, "model", match)]

    @staticmethod
    def _arrays(value: dict | None) -> dict | None:
        return None if value is None else {k: np.reshape(np.array(v["values"], float), v["shape"]) for k, v in value.items()}

    def migrate(self, key_of=None) -> int:
        """Moves documents that stand under another id than their digest to it; returns how many. A document that is there already wins."""
        moved = 0
        for name in sorted(os.listdir(f"{self.root}/index")):
            if name.startswith(".") or not name.endswith(".json"):
                continue
            path = f"{self.root}/index/{name}"
            with open(path) as f:
                document = json.load(f)
            key = (key_of or digest)(document["kind"], document["params"])
            target = self._document(document["kind"], key)
            if path != target:
                if not os.path.exists(target):
                    document["id"] = key
                    temporary = f"{self.root}/index/.{uuid.uuid4().hex}"
                    with open(temporary, "w") as f:
                        json.dump(document, f, default=str)
                    os.replace(temporary, target)
                os.unlink(path)
                moved += 1
        return moved

    def remove(self, spark: SparkSession, kind: str, match: dict) -> int:
        """Deletes matching documents and their tables; returns how many."""
        found = self.find(spark, kind, match, documents_only=True)
        for d in found:
            if "table" in d:
                path = spark._jvm.org.apache.hadoop.fs.Path(d["table"])
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            os.unlink(self._document(kind, d["id"]))
        return len(found)
