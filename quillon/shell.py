"""The shell's grammar: insert, get, update, delete, find, help, exit.

find takes tokens <field><op><value> (>=, <=, >, <, =), sort <field>, asc | desc and limit <n>, in any order.
Values of = stay text; range values are numbers.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.plans.request import Filter, FindRequest
from quillon.store import DocumentStore

TOKENS = ((">=", "gte"), ("<=", "lte"), (">", "gt"), ("<", "lt"), ("=", "eq"))
HELP = "insert <json> | get <id> | update <id> <json> | delete <id> | find [<field><op><value> ...] [sort <field>] [asc|desc] [limit <n>] | help | exit"


def parse_filter(token: str) -> Filter:
    for sign, op in TOKENS:
        name, found, value = token.partition(sign)
        if found:
            if not name or not value:
                raise ValueError(f"usage: <field>{sign}<value>")
            return Filter(name, op, value if op == "eq" else float(value))
    raise ValueError(f"not a filter: {token}")


def parse_find(text: str) -> FindRequest:
    filters, sort_by, ascending, limit = [], None, True, 0
    tokens = iter(text.split())
    for token in tokens:
        word = token.lower()
        if word == "sort":
            sort_by = next(tokens, None)
            if sort_by is None:
                raise ValueError("usage: sort <field>")
        elif word in ("asc", "desc"):
            ascending = word == "asc"
        elif word == "limit":
            value = next(tokens, "")
            if not value.isdigit() or int(value) <= 0:
                raise ValueError("limit takes a number above 0")
            limit = int(value)
        else:
            filters.append(parse_filter(token))
    return FindRequest(tuple(filters), sort_by, ascending, limit)


def pretty(doc: dict) -> str:
    """JSON with _id first and the other keys sorted."""
    return json.dumps({k: doc[k] for k in sorted(doc, key=lambda k: (k != "_id", k))}, indent=2, ensure_ascii=False)


def execute(store: DocumentStore, line: str) -> str | None:
    """The answer to a line; None ends the session."""
    verb, _, rest = line.strip().partition(" ")
    verb, rest = verb.lower(), rest.strip()
    try:
        if verb in ("exit", "quit"):
            return None
        if verb == "insert":
            return f"inserted {store.insert(json.loads(rest))[0]}"
        if verb == "get":
            return pretty(store.get(rest))
        if verb == "update":
            key, _, body = rest.partition(" ")
            return f"updated {store.update(key, json.loads(body))['_id']}"
        if verb == "delete":
            store.delete(rest)
            return f"deleted {rest}"
        if verb == "find":
            docs = [json.loads(r[0]) for r in store.find(parse_find(rest)).select(F.to_json("doc")).toLocalIterator()]
            return "\n".join([*map(pretty, docs), f"{len(docs)} document(s)"])
        return HELP if verb in ("help", "") else f"unknown command: {verb}\n{HELP}"
    except (ValueError, KeyError, PermissionError) as e:
        return f"error: {e.args[0] if e.args else e}"


def main() -> None:
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    store = DocumentStore(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    for line in sys.stdin:
        if (answer := execute(store, line)) is None:
            break
        print(answer)


if __name__ == "__main__":
    main()
