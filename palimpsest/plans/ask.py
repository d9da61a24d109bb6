"""Questions: route, retrieve, judge, answer, cite. Models are injected; the defaults work offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import answers
from palimpsest.operators.embedding import hashing_embedder
from palimpsest.operators.search import empty_groups, fan_out, filtered, narrowed, search
from palimpsest.plans.templates import TemplateError, Templates
from palimpsest.shared import cut

#: What the offline embedder's vectors are stored under, and the hits of each protocol when all are asked.
MODEL, SCHEME, FAN_OUT = "hashing", "v2", 8


@dataclass
class Answer:
    text: str
    citations: list[dict[str, Any]] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    data_gap: bool = False
    note: str = ""
    route: str = ""
    scope: str = ""
    filters: dict[str, Any] = field(default_factory=dict)


def offline_router(question: str, protocols: list[str]) -> dict[str, Any]:
    """Route by words: counting questions to sql, those that name a protocol to it."""
    low = question.lower()
    counting = any(w in low for w in ("how many", "count", "highest", "latest", "earliest"))
    named = next((p for p in protocols if p in low), None)
    return {"route": "sql" if counting else "vector", "scope": "one" if named else "all", "protocol": named, "template": "count_by_protocol", "params": {}}


def offline_writer(question: str, passages: list[dict[str, Any]], rows: list[dict[str, Any]]) -> str:
    if rows:
        return "; ".join(", ".join(f"{k}={v}" for k, v in r.items()) for r in rows[: answers.PREVIEW_ROWS])
    return " ".join(f"{p['chunk'][:160]} [{p['marker']}]" for p in passages[:3])


def written(said: str | dict[str, Any]) -> tuple[str, bool]:
    """A writer's text, and whether it says itself that what it was given doesn't answer the question."""
    if isinstance(said, dict):
        return str(said.get("answer") or "").strip(), bool(said.get("data_gap"))
    return said.strip(), False


@dataclass
class Assistant:
    """One question at a time. ``vectors`` has source, document_id, protocol_name, chunk_index, chunk, embedding,
    chunk_id, embedding_model and chunk_scheme; only those of ``model`` and ``scheme`` are searched."""

    spark: SparkSession
    vectors: DataFrame
    templates: Templates
    dimension: DataFrame
    embedder: Callable[[list[str]], list[list[float]]] = hashing_embedder
    router: Callable[[str, list[str]], dict[str, Any]] = offline_router
    judge: Callable[[list[str], list[str]], list[int]] = answers.overlap_judge
    #: Gives a text, or a dictionary with answer and data_gap.
    writer: Callable[[str, list[dict[str, Any]], list[dict[str, Any]]], str | dict[str, Any]] = offline_writer
    model: str = MODEL
    scheme: str = SCHEME

    def retrieve(self, question: str, plan: dict[str, Any]) -> tuple[DataFrame, list[str]]:
        """Hits without cut-offs, and the protocols that have none if all were asked."""
        query = self.embedder([question])[0]
        if plan["scope"] == "all" and not plan["protocol"]:
            seen = filtered(self.vectors, model=self.model, scheme=self.scheme, source=plan["source"])
            hits = cut(fan_out(seen, query, "protocol_name", FAN_OUT, tie="chunk_id"))  # few rows, which are read twice
            missing = [r[0] for r in empty_groups(self.dimension.select("protocol_name"), hits, "protocol_name").collect()]
            return hits, sorted(missing)
        k = answers.wanted(plan["route"], plan["scope"])
        hits = search(self.vectors, query, k, None, None, tie="chunk_id", model=self.model, scheme=self.scheme, protocol=plan["protocol"], source=plan["source"])
        return hits, []

    def structured(self, raw: dict[str, Any]) -> tuple[DataFrame | None, str]:
        try:
            return self.templates.render(raw.get("template", ""), raw.get("params")), ""
        except TemplateError as e:
            return None, str(e)

    def ask(self, question: str) -> Answer:
        """Route, retrieve, judge, answer and cite."""
        said: dict[str, Any] = {}
        for _, update in self.steps(question):
            said |= update
        return Answer(said["answer"], said["citations"], said.get("rows", []), said["data_gap"], said["note"], said["route"], said["scope"], said["filters"])

    def steps(self, question: str) -> Iterator[tuple[str, dict[str, Any]]]:
        """(step, what it adds) as each step is done: router, then sql, vector or hybrid, then synthesis."""
        names = [r[0] for r in self.dimension.select("protocol_name").collect()]
        raw = self.router(question, names)
        plan = answers.normalise_route(raw, names)
        yield "router", {"route": plan["route"], "scope": plan["scope"], "filters": {k: plan[k] for k in ("protocol", "source", "since")}}
        notes, rows, table, hits = [], [], None, None
        if plan["route"] in ("sql", "hybrid"):
            table, problem = self.structured(raw)
            rows = [r.asDict() for r in table.limit(answers.PREVIEW_ROWS).collect()] if table is not None else []
            notes += [problem] if problem else []
        if plan["route"] in ("vector", "hybrid"):
            hits, missing = self.retrieve(question, plan)
            notes += [f"nothing from {m}" for m in missing]
            if table is not None and "proposal_id" in table.columns:
                hits = narrowed(hits, table.select("proposal_id"))
        passages = self._relevant(question, hits) if hits is not None else []
        yield plan["route"], {"rows": rows, "chunks": passages, "note": "; ".join(notes)}
        if answers.is_gap(len(passages), len(rows)):
            yield "synthesis", {"answer": answers.GAP, "citations": [], "data_gap": True, "note": "; ".join(notes)}
            return
        text, gap = written(self.writer(question, passages, rows))
        kept, problems = self._cite(text, passages)
        yield "synthesis", {"answer": text, "citations": kept, "data_gap": gap or not text, "note": "; ".join([*notes, *problems])}

    def _relevant(self, question: str, hits: DataFrame) -> list[dict[str, Any]]:
        shown = answers.marked(hits, tie="chunk_id").withColumn("question", F.lit(question))
        scored = answers.score_passages(shown, self.judge, "question", "chunk").where(F.col("score") >= answers.RELEVANT)
        found = sorted((r.asDict() for r in scored.drop("embedding").collect()), key=lambda r: (r["distance"], r["chunk_id"]))
        for i, r in enumerate(found):
            r["marker"] = f"c{i}"
        return found

    def _cite(self, text: str, passages: list[dict[str, Any]]) -> tuple[list[dict[str, Any]], list[str]]:
        cited = self.spark.createDataFrame([(text,)], "answer string")
        known = [(p["marker"], p["source"], str(p["document_id"]), int(p["chunk_index"]), float(p["distance"])) for p in passages]
        table = self.spark.createDataFrame(known, "marker string, source string, document_id string, chunk_index long, distance double")
        found = answers.resolve_citations(cited, table).orderBy("place").collect()
        return [r.asDict() for r in found if r.problem is None], [r.problem for r in found if r.problem]
