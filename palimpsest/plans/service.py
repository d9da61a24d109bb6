"""The library over HTTP, as a WSGI application that any server can hold: proposals, chat, chat as events, health."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import parse_qs, unquote

from pyspark.sql import SparkSession

from palimpsest.plans.ask import Assistant
from palimpsest.plans.templates import TemplateError, Templates

STATUS = {200: "200 OK", 400: "400 Bad Request", 404: "404 Not Found", 405: "405 Method Not Allowed", 503: "503 Service Unavailable"}
PAGE = 20


class Problem(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


@dataclass
class Service:
    spark: SparkSession
    templates: Templates
    assistant: Assistant

    def proposals(self, protocol: str | None = None, state: str | None = None, limit: Any = PAGE, offset: Any = 0) -> list[dict[str, Any]]:
        return self._rows("list_proposals", {"protocol": protocol, "state": state, "limit": limit, "offset": offset})

    def proposal(self, id: str) -> dict[str, Any]:
        return self._found(self._rows("get_proposal", {"proposal_id": id}), id)[0]

    def history(self, id: str) -> list[dict[str, Any]]:
        return self._found(self._rows("get_proposal_history", {"proposal_id": id}), id)

    def _rows(self, name: str, params: dict[str, Any]) -> list[dict[str, Any]]:
        try:
            return [r.asDict(recursive=True) for r in self.templates.render(name, params).collect()]
        except TemplateError as e:
            raise Problem(400, str(e)) from e

    def _found(self, rows: list[dict[str, Any]], id: str) -> list[dict[str, Any]]:
        if not rows:
            raise Problem(404, f"no proposal {id!r}")
        return rows

    def chat(self, question: str) -> dict[str, Any]:
        said = self.assistant.ask(question)
        return {
            "question": question, "route": said.route, "scope": said.scope, "filters": said.filters, "answer": said.text,
            "data_gap": said.data_gap, "citations": said.citations, "retrieval_note": said.note,
        }

    def events(self, question: str) -> Iterator[str]:
        """A server-sent event for each step as it is done; a failure is an event, too."""
        try:
            for step, update in self.assistant.steps(question):
                chunks = [{**{k: v for k, v in c.items() if k != "embedding"}, "distance": round(c["distance"], 4)} for c in update.get("chunks", [])]
                yield self._event(step, update | ({"chunks": chunks} if "chunks" in update else {}))
        except Exception as e:  # noqa: BLE001  the stream has begun: all that is left is to say so in it
            yield self._event("error", {"error": str(e)})

    def _event(self, name: str, data: dict[str, Any]) -> str:
        return f"event: {name}\ndata: {json.dumps(data, default=str, ensure_ascii=False)}\n\n"

    def health(self) -> tuple[int, dict[str, Any]]:
        try:
            self.spark.sql("select 1").collect()
        except Exception as e:  # noqa: BLE001  whatever it is, the engine isn't well
            return 503, {"status": "degraded", "engine": {"status": "error", "detail": str(e)}}
        return 200, {"status": "ok", "engine": {"status": "ok"}}

    def __call__(self, environ: dict[str, Any], start_response: Callable) -> Iterator[bytes]:
        method, path = environ["REQUEST_METHOD"], unquote(environ.get("PATH_INFO", "")).rstrip("/")
        asked = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
        try:
            if method == "GET" and path.endswith("/chat/stream"):
                if not asked.get("question"):
                    raise Problem(400, "no question")
                start_response(STATUS[200], [("Content-Type", "text/event-stream; charset=utf-8")])
                return (e.encode() for e in self.events(asked["question"]))
            status, body = self._answer(method, path, asked, environ)
        except Problem as e:
            status, body = e.status, {"detail": e.detail}
        start_response(STATUS[status], [("Content-Type", "application/json; charset=utf-8")])
        return iter([json.dumps(body, default=str, ensure_ascii=False).encode()])

    def _answer(self, method: str, path: str, asked: dict[str, str], environ: dict[str, Any]) -> tuple[int, Any]:
        if path == "/health" and method == "GET":
            return self.health()
        if path.endswith("/chat"):
            if method != "POST":
                raise Problem(405, "questions are posted")
            try:
                question = json.loads(environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)))["question"]
            except (ValueError, KeyError, TypeError) as e:
                raise Problem(400, "no question") from e
            return 200, self.chat(str(question))
        hit = re.fullmatch(r".*/proposals(?:/([^/]+)(/history)?)?", path)
        if not hit:
            raise Problem(404, f"nothing at {path}")
        if method != "GET":
            raise Problem(405, "proposals are only read")
        if hit[1] is None:
            return 200, self.proposals(**{k: v for k, v in asked.items() if k in ("protocol", "state", "limit", "offset")})
        return 200, self.history(hit[1]) if hit[2] else self.proposal(hit[1])
