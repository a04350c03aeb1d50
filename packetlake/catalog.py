"""All registered queries of the network-traffic operators."""

import importlib

MODULES = ("q_detect", "q_traffic", "q_payload", "q_verify", "q_intel", "q_report", "q_stream", "q_models", "q_binary", "q_process", "q_parking")


def _all(kind: str) -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"packetlake.plans.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
