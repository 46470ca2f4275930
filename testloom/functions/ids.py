"""Stable test ids: version-5 UUIDs as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# UUID namespaces, the constant of the id's key, the prefix of raw ids that stand alone.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
KIND = "JUNIT_TESTCASE"
OWN_PREFIX = "trunk:"
UUID5 = r"^(?i)(?:urn:uuid:|\{)?[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}\}?$|^(?i)[0-9a-f]{12}5[0-9a-f]{19}$"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    return _uuid5(F.encode(name, "UTF-8"), namespace)


def uuid5_of_bytes(content: Column, namespace: str = NAMESPACE_OID) -> Column:
    return _uuid5(content, namespace)


def _uuid5(content: Column, namespace: str) -> Column:
    def laid_out(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

    # the lambda binds the hash: it is taken once, not once for each of its parts
    return F.transform(F.array(F.sha1(F.concat(F.unhex(F.lit(namespace)), content))), laid_out)[0]


def _joined(*parts: Column) -> Column:
    return F.concat_ws("#", *(F.coalesce(p, F.lit("")) for p in parts))


def test_id(org: Column, repo: Column, file: Column, classname: Column, parent: Column, name: Column, raw_id: Column | None = None, variant: Column | None = None) -> Column:
    """Id of a test: a hash of its identity, or of its raw id where that has the own prefix.

    A raw id that is a version-5 UUID is the id. With a variant, the id is hashed once
    more with it.
    """
    raw = F.coalesce(raw_id if raw_id is not None else F.lit(None).cast("string"), F.lit(""))
    var = F.coalesce(variant if variant is not None else F.lit(None).cast("string"), F.lit(""))
    has = var != ""
    tail = F.when(has, F.concat(F.lit("#"), var)).otherwise(F.lit(""))
    base = uuid5(F.concat(_joined(org, repo, file, classname, parent, name, F.lit(KIND)), tail))
    own = uuid5(F.concat(_joined(org, repo, raw), tail))
    first = F.when(raw.startswith(OWN_PREFIX), own).when(raw.rlike(UUID5), F.when(has, uuid5(_joined(raw, var))).otherwise(raw)).otherwise(base)
    # bound once too: it is used twice
    return F.transform(F.array(first), lambda x: F.when(has, uuid5(_joined(x, var))).otherwise(x))[0]


def run_id(org: Column, repo: Column, file: Column, classname: Column, parent: Column, name: Column, raw_id: Column, variant: Column) -> Column:
    """Rule of built runs: a raw id is taken as it is, even if empty, when there is no variant."""
    as_is = raw_id.isNotNull() & (F.coalesce(variant, F.lit("")) == "")
    return F.when(as_is, raw_id).otherwise(test_id(org, repo, F.coalesce(file, F.lit("")), classname, parent, name, raw_id, variant))


def failure_id(org: Column, repo: Column, file: Column, classname: Column, parent: Column, name: Column, raw_id: Column, variant: Column) -> Column:
    """Rule of extracted failures: a raw id that isn't empty is taken whatever the variant."""
    return F.coalesce(F.nullif(raw_id, F.lit("")), test_id(org, repo, file, classname, parent, name, None, variant))
