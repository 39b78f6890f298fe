"""What the driver renders: DOT graphs, prompts, and answers of a language model."""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import dot_escape, dot_slug, uid_color

# Shape, style and colour of nodes and edges in DOT.
SHAPES = {"process": ("box", None), "app": ("ellipse", "#fff4c2"), "socket": ("cylinder", "#c6e6c6"), "file": ("note", "#fde2c2"), "domain": ("diamond", "#e2d5f8")}
CLOSED, MASKED = "#e6e6fa", "#e0e0e0"
STYLES = {"parent_of": 'color="#444"', "frontmost_during": 'style=dashed, color="#bbb"', "opened_socket": 'color="#3a8a3a"', "queried_domain": 'style=dashed, color="#8a5fbf"'}


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line: a line of DOT for each node (kind, id, label, tooltip, uid, masked, perhaps closed) and edge, made on the executors."""
    kind = F.col("kind")
    shape, color = F.lit("box"), uid_color("uid")
    for k, (s, c) in SHAPES.items():
        shape = F.when(kind == k, s).otherwise(shape)
        color = F.when(kind == k, c).otherwise(color) if c else color
    color = F.when((kind == "domain") & F.coalesce("masked", F.lit(False)), MASKED).otherwise(color)
    if "closed" in nodes.columns:
        color = F.when((kind == "socket") & F.col("closed").isNotNull(), CLOSED).otherwise(color)
    ident = lambda k, i: F.concat(F.substring(k, 1, 1), dot_slug("_", i))
    n = nodes.select(F.lit(1).alias("part"), F.format_string('  "%s" [shape=%s, style=filled, fillcolor="%s", label="%s", tooltip="%s"];', ident(kind, F.col("id")), shape, color, dot_escape("label"), dot_escape(F.coalesce("tooltip", F.lit("")))).alias("line"))
    style = F.lit("")
    for k, s in STYLES.items():
        style = F.when(kind == k, s).otherwise(style)
    style = F.when(kind == "queried_domain", F.concat(style, F.lit(', label="'), F.col("count").cast("string"), F.lit('"'))).otherwise(style)
    e = edges.select(F.lit(2).alias("part"), F.format_string('  "%s" -> "%s" [%s];', ident("from_kind", F.col("from_id")), ident("to_kind", F.col("to_id")), style).alias("line"))
    return n.union(e)


def to_dot(nodes: DataFrame, edges: DataFrame, name: str = "telemetry") -> str:
    """The whole DOT text; for graphs that a person looks at."""
    rows = dot_lines(nodes, edges).orderBy("part", "line").toLocalIterator()
    return "\n".join([f"digraph {name} {{", "  rankdir=LR;", *[r["line"] for r in rows], "}", ""])


def prompt(sections: dict[str, DataFrame], header: str = "", instructions: str = "") -> str:
    """Sections (rows of one or more columns) in order, empty ones left out."""
    out = [header] if header else []
    for title, rows in sections.items():
        lines = [" ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows.toLocalIterator()]
        if lines:
            out += [f"## {title}", *lines]
    return "\n".join([*out, instructions] if instructions else out)


#: The order in which a window's prompt tells its facts; what is missing or empty is left out.
SECTIONS = ("event mix", "graph shape", "flags", "novelty", "focus", "processes", "endpoints", "directories", "domains")


def window_prompt(facts: dict[str, DataFrame], header: str, instructions: str = "") -> str:
    """The prompt of a window, its sections in the order of SECTIONS."""
    unknown = set(facts) - set(SECTIONS)
    if unknown:
        raise ValueError(f"no such sections: {sorted(unknown)}")
    return prompt({s: facts[s] for s in SECTIONS if s in facts}, header, instructions)


def bar(title: str, width: int = 60, tty: bool = False, mark: str = "=") -> str:
    """A title in a bar; in bold on a terminal."""
    text = f" {title} ".center(width, mark)
    return f"\033[1m{text}\033[0m" if tty else text


class LlmClient(Protocol):
    def generate(self, prompt: str) -> str: ...


class Http:
    """A model served over HTTP: POST /api/generate with model and prompt, the answer in `response`."""

    def __init__(self, url: str, model: str, timeout: float = 300):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def generate(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False}).encode()
        request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())["response"]


class Canned:
    """Answers in turn and keeps the prompts; the offline client."""

    def __init__(self, *answers: str):
        self.answers, self.calls = list(answers), []

    def generate(self, prompt: str) -> str:
        self.calls.append(prompt)
        return self.answers.pop(0) if self.answers else ""


def ask(client: LlmClient, text: str, model: str = "offline") -> dict:
    """summary, details and model; an answer that isn't a JSON object is the summary, without findings."""
    said = client.generate(text)
    try:
        found = json.loads(said)
        if not isinstance(found, dict):
            raise ValueError
        return {"summary": str(found.get("summary", "")), "details": found, "model": model}
    except ValueError:
        return {"summary": said, "details": {"findings": []}, "model": model}
