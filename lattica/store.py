"""Saved warehouses, report specs and dimension values, as JSON files of one folder."""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from lattica.errors import InvalidReportId, InvalidWarehouseId


class Store:
    """Each record is a file; a record is written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, kind: str, key: int | str) -> Path:
        return self.folder / kind / f"{key}.json"

    def _put(self, kind: str, key: int | str, record: dict) -> None:
        path = self._path(kind, key)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{uuid.uuid4().hex}")
        part.write_text(json.dumps(record))
        os.replace(part, path)

    def _new(self, kind: str, record: dict) -> int:
        """The next free id; taken by making its file, so that two writers never share one."""
        (self.folder / kind).mkdir(parents=True, exist_ok=True)
        key = max([0, *(int(p.stem) for p in (self.folder / kind).glob("*.json") if p.stem.isdigit())]) + 1
        while True:
            try:
                with self._path(kind, key).open("x") as f:
                    json.dump(record | {"id": key, "created_at": time.time()}, f)
                return key
            except FileExistsError:
                key += 1

    def _get(self, kind: str, key: int | str) -> dict | None:
        path = self._path(kind, key)
        return json.loads(path.read_text()) if path.exists() else None

    def save_warehouse(self, name: str, params: dict, meta: dict | None) -> int:
        if any(w["name"] == name for w in self.warehouses()):
            raise ValueError(f"a warehouse named {name!r} is saved already")
        return self._new("warehouses", {"name": name, "params": params, "meta": meta})

    def warehouses(self) -> list[dict]:
        return [json.loads(p.read_text()) for p in sorted((self.folder / "warehouses").glob("*.json"))]

    def load_warehouse(self, key: int) -> dict:
        if not (w := self._get("warehouses", key)):
            raise InvalidWarehouseId(f"no warehouse {key}")
        return w

    def delete_warehouse(self, key: int) -> None:
        self.load_warehouse(key)
        self._path("warehouses", key).unlink()

    def save_report(self, warehouse_id: int | None, params: dict, meta: dict | None) -> int:
        return self._new("reports", {"warehouse_id": warehouse_id, "params": params, "meta": meta})

    def load_report(self, key: int) -> dict:
        if not (r := self._get("reports", key)):
            raise InvalidReportId(f"no report spec {key}")
        return r

    def delete_report(self, key: int) -> None:
        self.load_report(key)
        self._path("reports", key).unlink()

    def put_values(self, warehouse_id: int | None, dimension: str, values: list) -> None:
        self._put("dimension_values", f"{warehouse_id}-{dimension}", {"values": values})

    def values(self, warehouse_id: int | None, dimension: str) -> list | None:
        found = self._get("dimension_values", f"{warehouse_id}-{dimension}")
        return found and found["values"]
