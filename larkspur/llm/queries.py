"""Queries of this subpackage for the driver, with SQL where SQL can express them."""

from __future__ import annotations

import importlib

_MODULES = ("url_filter", "record_files", "repetition", "mixing", "fm_quality", "lang_fusion", "adscan", "lpf_dedup", "circulant", "spm_scan", "wand", "token_align", "kneser_ney")


def _found(prefix: str):
    for name in _MODULES:
        module = importlib.import_module(f"larkspur.llm.{name}")
        yield from ((k, v) for k, v in vars(module).items() if k.startswith(prefix))


def queries() -> dict:
    return {k: v for k, v in _found("op") if callable(v)}


def oracle_sql() -> dict[str, str]:
    by_number = {k[2:-4]: v for k, v in _found("OP") if k.endswith("_SQL")}
    return {k: by_number[k[2:].split("_")[0]] for k in queries() if k[2:].split("_")[0] in by_number}
