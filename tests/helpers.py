"""Small bundles for scenarios."""

import json

from pyspark.sql import types as T

from arcwarden import schemas


def facts(spark, *rows):
    """Facts from (kind, hint, source, target, attributes[, provider[, account]])."""
    full = [(k, h, (p := (rest[0] if rest else "aws")), (p, rest[1] if len(rest) > 1 else "111111111111", "eu-1", False), s, t, json.dumps(a), None) for k, h, s, t, a, *rest in rows]
    return spark.createDataFrame(full, T.StructType.fromDDL(schemas.FACT))


def nodes(spark, *rows):
    """Nodes from (id, type[, arn[, attributes]]); provider and account come from the id."""
    full = []
    for id_, type_, *rest in rows:
        provider, account = (id_.split("|") + [""])[:2]
        full.append((id_, type_, provider, account, rest[0] if rest else None, None, json.dumps(rest[1]) if len(rest) > 1 else None))
    return spark.createDataFrame(full, T.StructType.fromDDL(schemas.NODE))


def edges(spark, *rows):
    """Edges from (type, source, target[, state[, weight[, confidence]]])."""
    full = [(t, s, d, *(list(rest) + ["ACTIVE", 1.0, 1.0][len(rest) :])) for t, s, d, *rest in rows]
    return spark.createDataFrame(full, "type string, source string, target string, state string, weight double, confidence double")


def doc(*statements):
    return json.dumps({"Statement": list(statements)})


def allow(action, resource=None, **more):
    return {"Effect": "Allow", "Action": action} | ({"Resource": resource} if resource else {}) | more


def deny(action, resource=None, **more):
    return allow(action, resource, **more) | {"Effect": "Deny"}
