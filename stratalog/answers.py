"""The JSON answers of the store's HTTP routes, as dictionaries. Errors are answers too: transport would send them all with status 200."""

from __future__ import annotations

from collections.abc import Callable

from stratalog.errors import StoreError
from stratalog.functions.keys import text_view
from stratalog.sources import snapshot
from stratalog.sources.store import Store


def _action(work: Callable[[], str]) -> dict:
    try:
        return {"success": True, "message": work()}
    except StoreError as e:
        return {"success": False, "message": str(e)}


def _text(x: str | bytes) -> str:
    return x.decode("utf-8", "replace") if isinstance(x, bytes) else x


def stats(db: Store) -> dict:
    return db.stats()


def get(db: Store, key: str) -> dict:
    """found, key, value; the value of a failed read is its error."""
    try:
        value = db.get(key)
    except StoreError as e:
        return {"found": False, "key": key, "value": f"error: {e}"}
    return {"found": value is not None, "key": key, "value": None if value is None else _text(value)}


def scan(db: Store, prefix: str = "", limit: int | None = None) -> dict:
    """At most 500 rows, 100 unless asked; a failed scan has none."""
    try:
        found = db.scan(prefix, limit, "http")
        return {"rows": [r.asDict() for r in found.select(*(text_view(found[c]).alias(c) for c in ("key", "value"))).collect()]}
    except StoreError:
        return {"rows": []}


def put(db: Store, key: str, value: str) -> dict:
    return _action(lambda: db.put(key, value) or f"stored {key}")


def delete(db: Store, key: str) -> dict:
    return _action(lambda: db.delete(key) or f"deleted {key}")


def flush(db: Store) -> dict:
    def work() -> str:
        r = db.flush()
        return f"flushed layer {r['layer_id']} of {r['entries']} entries" if r["flushed"] else "nothing to flush"

    return _action(work)


def compact(db: Store) -> dict:
    def work() -> str:
        r = db.compact()
        return f"compacted {r['input_layers']} layers into {r['output_layers']}, dropped {r['dropped_entries']} entries"

    return _action(work)


def demo(db: Store) -> dict:
    return _action(lambda: f"stored {db.apply(snapshot.demo(db.spark))} demo keys")


def import_rows(db: Store, text: str) -> dict:
    """success, imported, message; rows before the first that can't be stored are in and counted."""
    try:
        return db.import_json(text)
    except StoreError as e:
        return {"success": False, "imported": 0, "message": str(e)}
