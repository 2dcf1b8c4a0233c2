"""Profiles of settings: migrations of old ones, defaults, and storage as JSON."""

from __future__ import annotations

import copy
import json
import os
import re
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 11
#: What each version added, as version: section: key: default.
ADDED = {
    1: {"ocr": {"engine": "tesseract"}},
    2: {"ocr": {"max_pages": 0}},
    3: {"ocr": {"extra_tesseract_params": {}}},
    4: {"preprocess": {"auto_rotate": {"enabled": True, "min_confidence": 1.0}}, "ocr": {"adaptive_confidence_threshold": False, "per_word_script_disambiguation": False}},
    5: {"postprocess": {"mark_suspect_handwritten_blocks": False}},
    6: {"ocr": {"per_word_clahe_rescue": False, "per_word_upscale_rescue": False}},
    7: {"ocr": {"user_words_fuzzy_rescue": False}},
    8: {"postprocess": {"validate_entities": False}},
    9: {"ocr": {"per_block_psm_retry": False}},
    10: {"ocr": {"soft_rescue_dropped_words": False}},
    11: {"extract": {"enabled": False, "kind": "tn_upd", "multi_document": True, "low_text_threshold": 200, "cache_enabled": True, "org_lookup": True, "llm_fallback": {"enabled": False, "min_confidence": 0.4, "max_text_chars": 20_000}}},
}


def _default(into: dict, defaults: dict) -> None:
    for k, v in defaults.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _default(into[k], v)
        else:
            into.setdefault(k, copy.deepcopy(v))


def migrate(profile: dict) -> dict:
    """A profile of the current version; the argument stays as it is. Newer profiles keep all but their number."""
    p = copy.deepcopy(profile)
    version = int(p.get("schema_version", 0))
    for v in range(version + 1, VERSION + 1):
        if v == 2 and 0 < (p.get("ocr", {}).get("tesseract_timeout") or 0) < 300:
            p["ocr"]["tesseract_timeout"] = 300
        _default(p, ADDED[v])
    p["schema_version"] = VERSION
    return p


def load(text: str) -> dict:
    return migrate(json.loads(text))


def merged(builtin: list[dict], own: list[dict]) -> list[dict]:
    """Built-in profiles, then own ones, each by name; an own one stands in for a built-in of its name."""
    mine = {p["name"]: p for p in own}
    names = {p["name"] for p in builtin}
    return [mine.get(p["name"], p) for p in sorted(builtin, key=lambda p: p["name"])] + [mine[n] for n in sorted(mine) if n not in names]


def store(folder: str, profiles: list[dict]) -> None:
    """A file for each profile, under its name."""
    os.makedirs(folder, exist_ok=True)
    for p in profiles:
        path = os.path.join(folder, re.sub(r"[^\w.\-]", "_", p["name"]) + ".json")
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(p, f, ensure_ascii=False)
        os.replace(f"{path}.part", path)


def listed(builtin: str, own: str) -> list[dict]:
    """Migrated profiles of two folders, as ``merged`` orders them; files that do not parse are passed by."""

    def of(folder: str) -> list[dict]:
        out = []
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if name.endswith(".json"):
                try:
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        out.append(load(f.read()))
                except (ValueError, AttributeError, TypeError):
                    continue
        return [p for p in out if isinstance(p.get("name"), str)]

    return merged(of(builtin), of(own))


def archive(path: str, settings: dict, profiles: list[dict]) -> None:
    """Settings and profiles as one zip file."""
    with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("settings.json", json.dumps(settings, ensure_ascii=False))
        for i, p in enumerate(profiles):
            z.writestr(f"profiles/{i:04d}.json", json.dumps(p, ensure_ascii=False))
    os.replace(f"{path}.part", path)


def unarchived(path: str) -> tuple[dict, list[dict]]:
    with zipfile.ZipFile(path) as z:
        names = sorted(n for n in z.namelist() if n.startswith("profiles/"))
        return json.loads(z.read("settings.json")), [load(z.read(n).decode()) for n in names]


def typed(rows: DataFrame, column: str, fields: dict[str, tuple[str, object, list | None]]) -> DataFrame:
    """``rows`` with a JSON ``column`` as typed fields: name to (type, default, allowed values or None).

    What is missing, of another type or not allowed becomes the default; other keys are left out.
    """
    parsed = F.from_json(column, ", ".join(f"{n} {t}" for n, (t, _, _) in fields.items()))
    out = rows.withColumn("__p", parsed)

    def one(name: str, default: object, allowed: list | None) -> Column:
        value = F.col(f"__p.{name}")
        return F.coalesce(value if allowed is None else F.when(value.isin(*allowed), value), F.lit(default)).alias(name)

    return out.select(*[c for c in rows.columns if c != column], *[one(n, d, a) for n, (_, d, a) in fields.items()])
