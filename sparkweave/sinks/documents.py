"""Document tables: keyed loads with a masking policy (SNK-11..13, SRC-9, SRC-10,
FLT-1, FLT-2, GOV-2..4).

Documents are rows keyed by ``_id``.  The policy (column -> mask) is a small
keyed table next to the data.  Readers get the masked projection unless they
are listed as unmasked readers (the owner by default), i.e. the default read
permission is "public, masked".
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.masks import MASKS
from sparkweave.operators import documents as q
from sparkweave.operators.governance import POLICY_SCHEMA, masked_view
from sparkweave.operators.upsert import check_keys
from sparkweave.sinks import loads


class DocumentTable:
    def __init__(self, spark: SparkSession, path: str, name: str | None = None, key: str = "_id",
                 unmasked_readers: Iterable[str] = ("owner",)):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.name = name or self.path.rsplit("/", 1)[-1]
        self.unmasked_readers = tuple(unmasked_readers)
        self.data, self.policies = f"{self.path}/data", f"{self.path}/policy"

    # ---- lifecycle --------------------------------------------------------
    def create(self, schema: T.StructType) -> None:
        """Create an empty table (idempotent) with an empty policy."""
        if self.key not in schema.fieldNames():
            raise ValueError(f"schema needs the key column {self.key!r}")
        if not loads.loads(self.spark, self.data):
            loads.append_load(self.spark.createDataFrame([], schema), self.data, 0)

    def add(self, docs: DataFrame, load: int | None = None) -> int:
        """Insert-or-replace documents by key (the later duplicate wins when
        ``_seq`` is present, else duplicates must not occur)."""
        order = "_seq" if "_seq" in docs.columns else None
        return loads.upsert_load(docs, self.data, self.key, order, load)

    upsert = add

    def insert(self, docs: DataFrame, load: int | None = None) -> int:
        """Insert new documents; a key that is NULL, repeated or stored already
        is refused, and then nothing is written.  A load that is there already
        is a replay."""
        there = loads.loads(self.spark, self.data)
        if load is not None and load in there:
            return load
        check_keys(docs, self.key, unique=True)
        if there and not docs.join(loads.read_loads(self.spark, self.data).select(self.key), self.key, "left_semi").isEmpty():
            raise ValueError(f"documents with a stored {self.key!r}")
        return loads.append_load(docs, self.data, load)

    # ---- policy -----------------------------------------------------------
    def policy(self) -> DataFrame:
        schema = T._parse_datatype_string(POLICY_SCHEMA)
        return loads.read_latest(self.spark, self.policies, ["table", "column"], schema)

    def set_mask(self, column: str, mask: str) -> None:
        self.set_masks({column: mask})

    def set_masks(self, masks: dict[str, str]) -> None:
        """Set several masks in one load (replacing older ones)."""
        schema = loads.table_schema(self.spark, self.data)
        for column, mask in masks.items():
            if mask not in MASKS:
                raise ValueError(f"unknown mask {mask!r}")
            if schema is not None and column not in schema.fieldNames():
                raise ValueError(f"unknown column {column!r} for table {self.name!r}")
        rows = self.spark.createDataFrame([(self.name, c, m) for c, m in masks.items()], POLICY_SCHEMA)
        loads.upsert_load(rows.coalesce(1), self.policies, ["table", "column"])

    def get_masks(self) -> DataFrame:
        return self.policy().where(F.col("table") == self.name).select("column", "mask")

    # ---- reads ------------------------------------------------------------
    def read(self, principal: str = "public") -> DataFrame:
        return masked_view(loads.read_latest(self.spark, self.data, self.key), self.policy(), self.name, principal, self.unmasked_readers)

    def find_by_id(self, doc_id, principal: str = "public") -> DataFrame:
        return masked_view(loads.lookup(self.spark, self.data, self.key, doc_id), self.policy(), self.name, principal, self.unmasked_readers)

    def search(self, select: list[str] | None = None, where: dict | None = None,
               principal: str = "public") -> DataFrame:
        return q.search(self.read(principal), select, where)

    def peek(self, limit: int | None = 10, principal: str = "public") -> DataFrame:
        return q.peek(self.read(principal), limit, order_by=[self.key])
