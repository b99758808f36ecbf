"""A tool server: JSON-RPC, a line a message, over standard input and output, as clients of the Model Context Protocol speak it."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import SparkSession

from lantern import cli
from lantern.config import Config
from lantern.plans import search

# Fixed values of the protocol.
VERSION, UNKNOWN_METHOD, WRONG_PARAMETERS, FAILED, NOT_JSON = "2025-06-18", -32601, -32602, -32603, -32700
#: Characters of the best passage that an answer quotes.
QUOTED = 4000

TOOLS = {
    "recall": ("Find the document that states the answer to a full question. Gives files with the probability that they state it, the heading, and the best passage; low scores mean that none does.", {"question": "string", "top": "integer"}),
    "search": ("Fast search by words and meaning, without the scorer.", {"query": "string", "k": "integer"}),
    "reindex": ("Bring the index up to date with the files.", {}),
}


class Tools:
    """The tools over one configuration; the index is opened once and again after a reindex."""

    def __init__(self, spark: SparkSession, c: Config):
        self.spark, self.c, self._index = spark, c, None

    @property
    def index(self) -> search.Index:
        self._index = self._index or cli.open_index(self.spark, self.c)
        return self._index

    def recall(self, question: str, top: int = 5) -> dict:
        hits, log = cli.answer.recall(cli.one_query(self.spark, question), self.index, self.c, cli.search_settings(self.c), int(top))
        rows, said = hits.orderBy("rank").collect(), log.first()
        results = [{"path": r.path, "score": r.score, "section": r.section} for r in rows]
        return {"mode": said["mode"], "widened": said.widened, "usd": said.usd, "note": said.note, "results": results, "best_section_text": (rows[0].passage or "")[:QUOTED] if rows else ""}

    def search(self, query: str, k: int = 10) -> list:
        found = search.hybrid(cli.one_query(self.spark, query), self.index, int(k), cli.search_settings(self.c)).orderBy("rank").collect()
        return [{"path": r.path, "score": round(r.score, 5)} for r in found]

    def reindex(self) -> dict:
        self._index = None
        return cli.build_index(self.spark, self.c)


def _listed() -> list[dict]:
    return [{"name": name, "description": text, "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in given.items()}, "required": [k for k, v in given.items() if v == "string"]}} for name, (text, given) in TOOLS.items()]


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to a message; None to a notification."""
    method, given = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None

    def reply(**body) -> dict:
        return {"jsonrpc": "2.0", "id": message["id"], **body}

    if method == "initialize":
        return reply(result={"protocolVersion": given.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "lantern", "version": "1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": _listed()})
    if method != "tools/call":
        return reply(error={"code": UNKNOWN_METHOD, "message": f"unknown method {method!r}"})
    name, wanted = given.get("name"), given.get("arguments") or {}
    if name not in TOOLS or set(wanted) - set(TOOLS[name][1]) or {k for k, v in TOOLS[name][1].items() if v == "string"} - set(wanted):
        return reply(error={"code": WRONG_PARAMETERS, "message": f"no tool {name!r} with arguments {sorted(wanted)}"})
    try:
        said, failed = json.dumps(getattr(tools, name)(**wanted)), False
    except Exception as e:  # the client is told, and the server goes on
        said, failed = f"{type(e).__name__}: {str(e)[:500]}", True
    return reply(result={"content": [{"type": "text", "text": said}], "isError": failed})


def serve(tools: Tools, into: TextIO, out: TextIO) -> None:
    for line in into:
        if not line.strip():
            continue
        try:
            said = answer(tools, json.loads(line))
        except ValueError:
            said = {"jsonrpc": "2.0", "id": None, "error": {"code": NOT_JSON, "message": "not JSON"}}
        if said is not None:
            print(json.dumps(said), file=out, flush=True)
