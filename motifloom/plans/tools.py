"""The tools of a session by name, and as JSON-RPC requests."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Any

from .service import Session

#: names that clients call, and what each needs; the rest of a call's arguments goes on as settings
TOOLS: dict[str, tuple[str, tuple[str, ...]]] = {
    "compress_tokens": ("compress_tokens", ("tokens",)),
    "decompress_tokens": ("decompress_tokens", ("tokens",)),
    "analyze_compression": ("analyze", ("tokens",)),
    "compress_text": ("compress_text", ("text",)),
    "compress_context": ("compress_context", ("turns",)),
    "compress_streaming": ("compress_streaming", ("tokens",)),
    "get_session_metrics": ("session_metrics", ()),
    "get_historical_metrics": ("historical_metrics", ()),
    "run_benchmark": ("benchmark", ()),
    "reset_session_metrics": ("reset_session_metrics", ()),
    "get_pattern_cache_stats": ("pattern_cache_stats", ()),
    "clear_pattern_cache": ("clear_pattern_cache", ()),
    "get_quality_summary": ("quality_summary", ()),
}


def listed() -> list[dict[str, Any]]:
    """Name, what it does, and which arguments each tool needs and takes."""
    out = []
    for name, (method, needs) in TOOLS.items():
        own = getattr(Session, method)
        takes = [p for p in inspect.signature(own).parameters if p not in ("self", "changes")]
        out.append({"name": name, "description": (inspect.getdoc(own) or name.replace("_", " ")).split("\n")[0], "inputSchema": {"type": "object", "properties": {p: {} for p in takes}, "required": list(needs)}})
    return out


def call(session: Session, name: str, arguments: dict[str, Any] | None = None) -> Any:
    """The result of a tool; KeyError for one that isn't known, ValueError for arguments it can't take."""
    method, needs = TOOLS[name]
    arguments = dict(arguments or {})
    if missing := [n for n in needs if n not in arguments]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    own: Callable = getattr(session, method)
    try:
        inspect.signature(own).bind(**arguments)
    except TypeError as wrong:
        raise ValueError(f"{name}: {wrong}") from wrong
    return own(**arguments)


def _failed(request_id: Any, code: int, message: str) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": request_id, "error": {"code": code, "message": message}}


def handled(session: Session, request: str | dict[str, Any]) -> dict[str, Any] | None:
    """The answer to a JSON-RPC request (``initialize``, ``tools/list``, ``tools/call``); None to a notification."""
    try:
        own = json.loads(request) if isinstance(request, str) else request
    except ValueError:
        return _failed(None, -32700, "not JSON")
    if not isinstance(own, dict) or not isinstance(own.get("method"), str):
        return _failed(None, -32600, "not a request")
    number, method, given = own.get("id"), own["method"], own.get("params") or {}
    if "id" not in own:
        return None
    if method == "initialize":
        return {"jsonrpc": "2.0", "id": number, "result": {"serverInfo": {"name": "motifloom"}, "capabilities": {"tools": {}}}}
    if method == "tools/list":
        return {"jsonrpc": "2.0", "id": number, "result": {"tools": listed()}}
    if method != "tools/call":
        return _failed(number, -32601, f"no such method: {method}")
    if not isinstance(given, dict) or given.get("name") not in TOOLS:
        return _failed(number, -32602, "no such tool")
    try:
        done = call(session, given["name"], given.get("arguments"))
    except (ValueError, TypeError) as wrong:
        return _failed(number, -32602, str(wrong))
    except Exception as wrong:  # noqa: BLE001 - the server goes on
        return _failed(number, -32603, str(wrong))
    return {"jsonrpc": "2.0", "id": number, "result": {"content": [{"type": "text", "text": json.dumps(done, default=list)}]}}
