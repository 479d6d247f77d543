"""Tables by a dbt manifest."""

from __future__ import annotations

import json

from .resolve import SourceError


def load_manifest(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except OSError as e:
        raise SourceError(f"{path} cannot be read: {e.strerror}; run dbt compile first") from None
    except ValueError:
        raise SourceError(f"{path} is no JSON") from None
    if not isinstance(found.get("nodes") if isinstance(found, dict) else None, dict):
        raise SourceError(f"{path} has no nodes; it is not a manifest")
    return found


def models(manifest: dict, select: list[str] | None = None, ephemeral: bool = False) -> list[dict]:
    """The models, seeds and snapshots that have tables, by name: name, unique_id, database, schema, alias."""
    tables = [
        {"name": str(n.get("name") or ""), "unique_id": key, "database": str(n.get("database") or ""), "schema": str(n.get("schema") or ""), "alias": str(n.get("alias") or n.get("name") or ""), "materialized": str((n.get("config") or {}).get("materialized") or n.get("materialized") or ""), "description": str(n.get("description") or "")}
        for key, n in manifest["nodes"].items() if isinstance(n, dict) and n.get("resource_type") in ("model", "seed", "snapshot")
    ]
    tables = [t for t in tables if ephemeral or t["materialized"] != "ephemeral"]
    if select:
        names = {x for t in tables for x in (t["name"], t["unique_id"])}
        lost = sorted(set(select) - names)
        if lost:
            raise SourceError(f"the manifest has no {', '.join(lost)}; it has {', '.join(sorted(t['name'] for t in tables)[:12]) or 'none'}")
        tables = [t for t in tables if {t["name"], t["unique_id"]} & set(select)]
    return sorted(tables, key=lambda t: t["name"])


def sources(manifest: dict, warehouse: str, select: list[str] | None = None) -> list[tuple[str, str]]:
    """(table, source) of each model. warehouse: what stands before #, or table:// for the catalog."""
    if not warehouse:
        raise SourceError("a manifest names tables but no way to them: give a warehouse")
    out = []
    for t in models(manifest, select):
        place = f"{t['schema']}.{t['alias']}" if t["schema"] else t["alias"]
        out.append((t["name"], f"table://{place}" if warehouse.startswith("table:") else f"{warehouse.split('#')[0]}#{place}"))
    return out
