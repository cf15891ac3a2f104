"""Tools over JSON-RPC, one message a line."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from sourceloom import __version__
from sourceloom.engine import FOLDER, Engine
from sourceloom.operators.verify import feedback
from sourceloom.sources.repo import find_projects


def _tool(name: str, description: str, required: list[str], **properties: str) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "required": required, "properties": {k: {"type": t} for k, t in properties.items()}}}


TOOLS = [
    _tool("scan", "The symbol map of a source tree", ["repo"], repo="string", depth="integer"),
    _tool("search", "Chunks of a source tree that fit a query", ["repo", "query"], repo="string", query="string", top_k="integer"),
    _tool("pipeline", "A prompt for a task, within a token budget", ["repo", "task"], repo="string", task="string", budget="integer", top_k="integer"),
    _tool("verify", "The checks of a project", ["repo"], repo="string", kinds="array"),
]


def call(engine: Engine, name: str, a: dict) -> str:
    """Runs a tool; its text."""
    if name == "scan":
        scan = engine.scan(a["repo"])
        return scan.text(a.get("depth", 2)) + "\n" + json.dumps(scan.totals())
    if name == "search":
        roots = find_projects(a["repo"], FOLDER)
        rows = engine.search(roots if len(roots) > 1 else roots[0], a["query"], a.get("top_k", 10)).collect()
        return "\n\n".join(f"# {r['path']}  L{r['start_line']}-{r['end_line']}  score {r['score']:.4f}\n{r['content']}" for r in rows) or "nothing found"
    if name == "pipeline":
        out = engine.pipeline(a["task"], a["repo"], a.get("budget", 8000), a.get("top_k", 10), record=False, context=False)
        if out is None:
            prompt, stats = engine.pack({"task": a["task"]}, a.get("budget", 8000))
            return f"chunks: 0, tokens before trimming: {stats['total_before_trim']}\n\n{prompt}"
        return f"chunks: {out['trace']['chunks_retrieved']}, tokens before trimming: {out['stats']['total_before_trim']}\n\n{out['prompt']}"
    if name == "verify":
        return feedback(engine.verify(a["repo"], set(a["kinds"]) if a.get("kinds") else None).collect())
    raise KeyError(name)


def answer(engine: Engine, message: dict) -> dict | None:
    """The response to a message; None to a notification."""
    number, method = message.get("id"), message.get("method", "")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "sourceloom", "version": __version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        asked = message.get("params", {})
        if asked.get("name") not in {t["name"] for t in TOOLS}:
            return reply | {"error": {"code": -32601, "message": f"no tool {asked.get('name')}"}}
        try:
            return reply | {"result": {"content": [{"type": "text", "text": call(engine, asked["name"], asked.get("arguments", {}))}]}}
        except Exception as e:
            return reply | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)}]}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answers messages until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            response: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            response = answer(engine, message)
        if response is not None:
            print(json.dumps(response), file=sink, flush=True)
