"""What a user calls: ``search_code`` and ``reindex`` of a tree, ``watch``, and a server that offers the first two as tools.

An index lies in the tree's state folder unless a store is named, and is built on the first search. The server
speaks JSON-RPC 2.0, one message a line, over two text streams; nothing but answers goes to the output.
"""

from __future__ import annotations

import json
import os
import sys
from typing import IO

from pyspark.sql import SparkSession

from lodeseek.functions.hashing import Embedder, FeatureHash, choose_embedder
from lodeseek.operators.rerank import wire_hits
from lodeseek.plans.search import Corpus, Knobs, search
from lodeseek.sources.repo import walk
from lodeseek.sources.store import Registry, Store, migrate, open_or_build
from lodeseek.sources.store import reindex as bring_up_to_date
from lodeseek.streaming.watch import default_store, watch_tree

NAME, PROTOCOL = "lodeseek", "2024-11-05"
REGISTRY = os.path.join(os.environ.get("XDG_CONFIG_HOME", os.path.expanduser("~/.config")), NAME, "registry.json")


def active_embedder(requested: str | None = None, model_path: str | None = None) -> Embedder:
    """The embedder that is asked for, or feature hashing, with the reason on stderr, where that one can't be had."""
    kind, reason = choose_embedder(requested, model_path, os.path.exists)
    if kind != "feature-hash":
        reason = f"no {kind} embedder can be loaded here"
    if reason:
        print(f"{reason}; feature hashing takes its place", file=sys.stderr)
    return FeatureHash()


def store_of(spark: SparkSession, root: str, store: str | None = None) -> Store:
    return Store(spark, store or f"file://{default_store(root)}")


def reindex(spark: SparkSession, path: str, *, force: bool = False, store: str | None = None, embedder: Embedder | None = None, registry: str | None = None) -> dict:
    """Brings the index of the tree at ``path`` up to date, or builds it anew with ``force``, and reports."""
    embedder, at = embedder or active_embedder(), store_of(spark, path, store)
    if at.exists() and not force:
        migrate(at, embedder)
    report = bring_up_to_date(at, walk(spark, path), embedder, force=force)
    if registry:
        Registry(registry).register(path, at.path.removeprefix("file://"))
    return report


def search_code(
    spark: SparkSession,
    path: str,
    query: str,
    *,
    k: int = 10,
    rrf_k: int = 60,
    bm25_weight: float | None = None,
    vector_weight: float | None = None,
    adaptive: bool = False,
    diversify: bool = False,
    boost_imports: bool = False,
    store: str | None = None,
    embedder: Embedder | None = None,
) -> dict:
    """``{"hits": [...]}``: the best chunks of the tree at ``path`` for one query. The first search builds the index;
    an index of another embedder or schema is refused."""
    embedder, at = embedder or active_embedder(), store_of(spark, path, store)
    open_or_build(at, lambda: walk(spark, path), embedder)
    knobs = Knobs(k=max(0, k), k_rrf=rrf_k, bm25_weight=bm25_weight, vector_weight=vector_weight, adaptive=adaptive, diversify=diversify, boost_imports=boost_imports)
    if not knobs.k:
        return {"hits": []}
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    found = wire_hits(search(asked, Corpus.of(at, embedder), embedder, knobs)).first()
    return json.loads(found["json"]) if found else {"hits": []}


def watch(spark: SparkSession, path: str, *, store: str | None = None, checkpoint: str | None = None):
    """A running stream that reindexes the tree at ``path`` whenever it has changed."""
    at = store_of(spark, path, store)
    return watch_tree(spark, path, lambda: reindex(spark, path, store=at.path), checkpoint or f"{at.path}/watch")


_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "number"}, {"type": "boolean"}
TOOLS = {
    "search_code": (
        search_code,
        "Search the source tree at path by words and vectors, fused by reciprocal ranks; the first search builds the index.",
        {"path": _TEXT, "query": _TEXT, "k": {"type": "integer"}, "rrf_k": {"type": "integer"}, "bm25_weight": _NUMBER, "vector_weight": _NUMBER, "adaptive": _FLAG, "diversify": _FLAG, "boost_imports": _FLAG},
        ["path", "query"],
    ),
    "reindex": (reindex, "Bring the index of the tree at path up to date, or build it anew with force.", {"path": _TEXT, "force": _FLAG}, ["path"]),
}


def answer(spark: SparkSession, message: dict) -> dict | None:
    """The answer to one JSON-RPC message; None for a notification."""
    method, params, key = message.get("method"), message.get("params") or {}, message.get("id")
    if key is None:
        return None
    reply = {"jsonrpc": "2.0", "id": key}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (_, d, p, r) in TOOLS.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"no tool {name}"}}
    call, _, known, needed = TOOLS[name]
    if wrong := [x for x in given if x not in known] or [x for x in needed if x not in given]:
        return reply | {"error": {"code": -32602, "message": f"unknown or missing argument {wrong[0]}"}}
    try:
        result = call(spark, given["path"], *([given["query"]] if "query" in given else []), **{x: v for x, v in given.items() if x not in ("path", "query") and v is not None})
    except Exception as e:
        return reply | {"error": {"code": -32603, "message": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}}
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}], "structuredContent": result}}


def serve(spark: SparkSession, source: IO[str] | None = None, sink: IO[str] | None = None) -> None:
    """Answers messages until the source ends."""
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(spark, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
