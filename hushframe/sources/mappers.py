"""Connector payloads to typed rows, and the catalogue of connectors.

A payload is one JSON document whose records stand in one array. A record without its required id fails the whole
payload; any other absent or wrongly typed value is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.errors import Malformed


@dataclass(frozen=True)
class Mapper:
    """dataset: its name; records: where the array is; fields: (column, JSON path, type), the first one required."""

    dataset: str
    records: str
    fields: tuple[tuple[str, str, str], ...]

    def rows(self, payloads: DataFrame, column: str = "payload") -> DataFrame:
        """Rows of all payloads (a column of JSON texts). Malformed if one is no JSON, has no array, or a record has no id."""
        value = F.try_parse_json(F.col(column))
        records = F.try_variant_get(value, self.records, "array<variant>")
        broken = payloads.agg(F.count_if(records.isNull())).first()[0]
        if broken:
            raise Malformed
        each = payloads.select(F.explode(records).alias("record"))
        out = each.select(*[_typed(F.col("record"), path, kind).alias(name) for name, path, kind in self.fields])
        if not out.filter(F.col(self.fields[0][0]).isNull()).isEmpty():
            raise Malformed("a record has no id")
        return out


# Type names in schema_of_variant.
_KINDS = {"string": ("STRING",), "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",)}


def _typed(value: Column, path: str, kind: str) -> Column:
    member = F.try_variant_get(value, path, "variant")
    right = F.lit(False)
    for prefix in _KINDS[kind]:
        right = right | F.schema_of_variant(member).startswith(prefix)
    return F.when(member.isNotNull() & right, F.try_variant_get(value, path, kind))


INVOICES = Mapper("invoices", "$.QueryResponse.Invoice", (("id", "$.Id", "string"), ("customer", "$.CustomerRef.name", "string"), ("txn_date", "$.TxnDate", "string"), ("currency", "$.CurrencyRef.value", "string"), ("total", "$.TotalAmt", "double"), ("balance", "$.Balance", "double")))
PARTNERS = Mapper("partners", "$.result", (("id", "$.id", "bigint"), ("name", "$.name", "string"), ("email", "$.email", "string"), ("is_company", "$.is_company", "boolean")))
CONTACTS = Mapper("contacts", "$.contacts", (("id", "$.id", "string"), ("name", "$.name", "string"), ("email", "$.email", "string"), ("stage", "$.stage", "string")))

# Connector, kind, how it signs in.
CONNECTORS = (("quickbooks", "accounting", "oauth2"), ("odoo", "erp", "api_key"), ("generic_crm", "crm", "oauth2"), ("research_extract", "research", "api_key"))
MAPPERS = {"quickbooks": INVOICES, "odoo": PARTNERS, "generic_crm": CONTACTS}


def connectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONNECTORS, "connector string, kind string, auth string")
