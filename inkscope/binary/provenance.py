"""Who declares to have made a file: generator names and AI-content labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and the patterns that give them, in order of precedence.
GENERATORS = (
    ("claude", r"claude\b"), ("anthropic", r"anthropic\b"), ("chatgpt", r"chat ?gpt\b"), ("openai", r"open ?ai\b"),
    ("dalle", r"dall ?e"), ("sora", r"sora\b"), ("midjourney", r"mid ?journey\b"), ("stable diffusion", r"stable ?diffusion\b"),
    ("stability ai", r"stability ?ai\b"), ("sdxl", r"sdxl\b"), ("automatic1111", r"automatic1111\b"), ("comfyui", r"comfy ?ui\b"),
    ("ideogram", r"ideogram\b"), ("novelai", r"novel ?ai\b"), ("leonardo.ai", r"leonardo ?ai\b"),
    ("playground ai", r"playground ?ai\b"), ("black forest labs", r"black ?forest ?labs\b"), ("deepseek", r"deep ?seek\b"),
    ("perplexity", r"perplexity\b"), ("mistral", r"mistral\b"), ("qwen", r"qwen"), ("moonshot", r"moonshot\b"),
    ("kimi", r"\bkimi\b"), ("grok", r"grok\b"), ("llama", r"llama\b"), ("gemini", r"gemini\b"), ("copilot", r"copilot\b"),
    ("meta ai", r"meta ?ai\b"), ("x.ai", r"x ?ai\b"), ("google ai", r"google ?ai\b"), ("doubao", r"doubao\b"),
    ("jimeng", r"jimeng\b"), ("kling", r"\bkling\b"), ("keling", r"keling\b"), ("yuanbao", r"yuanbao\b"),
    ("ernie", r"ernie ?(?:bot|\d)"), ("wenxin", r"wenxin\b"), ("liblib", r"liblib(?: ?ai)?\b"), ("hailuo", r"hailuo\b"),
    ("minimax", r"minimax ?(?:ai|abab|\d)"), ("seedream", r"seedream\b"), ("seedance", r"seedance\b"), ("hunyuan", r"hunyuan\b"),
    ("zhipu", r"zhipu\b"), ("tongyi", r"tongyi\b"), ("nano banana", r"nano ?banana\b"), ("gpt", r"gpt ?\d"), ("glm", r"glm ?\d"),
    ("flux.1", r"flux ?\d"), ("firefly", r"firefly ?\d"), ("imagen", r"imagen ?\d"), ("runway", r"runway ?(?:ml|gen)\b"),
    ("wan", r"wan ?\d"), ("vidu", r"vidu ?(?:q|\d)"),
)
#: Fields that name a tool, and the label of AI-generated content.
TOOL_FIELDS = ("Software", "CreatorTool", "Application", "generator", "Producer", "Creator")
AIGC = "AIGC"
_NAMESPACE = b"http://www.tc260.org.cn/ns/AIGC/"
_NOTE = "declared under GB 45438-2025"

_ANCHORED = [(n, re.compile(r"\b" + p)) for n, p in GENERATORS]
_ANYWHERE = [(n, re.compile(p)) for n, p in GENERATORS]


def fold(value: str) -> str:
    """Lower-case letters and digits, anything else one space."""
    return re.sub(r"[^a-z0-9]+", " ", value.lower()).strip(" ")


def generator(value: str, anywhere: bool = False) -> str | None:
    """The first generator that a value names."""
    v = fold(value)
    return next((n for n, p in (_ANYWHERE if anywhere else _ANCHORED) if p.search(v)), None)


def folded(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def generator_of(value: Column) -> Column:
    """``generator`` as a column expression."""
    v = folded(value)
    out = F.when(F.lit(False), "")
    for name, pattern in GENERATORS:
        out = out.when(v.rlike(r"\b" + pattern), name)
    return out


# -- AI-content labels in raw bytes ---------------------------------------------------

_LABEL_OBJECT = re.compile(rb"AIGC[ \t\r\n\"':]*(?=\{)")


def _object_end(raw: bytes, at: int) -> int:
    """End of the brace-balanced object at ``at``, -1 if it is not closed."""
    depth = 0
    for m in re.compile(rb"[{}]").finditer(raw, at):
        depth += 1 if m[0] == b"{" else -1
        if not depth:
            return m.end()
    return -1


def _field(raw: bytes, name: bytes) -> str:
    """Value of an XML element or attribute-like field, else of a JSON string; or empty."""
    at = raw.find(name + b">")
    if at >= 0:
        text = raw[at + len(name) + 1 :].split(b"<", 1)[0].decode("utf-8", "replace").strip().strip('"}')
        if text:
            return text
    m = re.search(rb'"' + name + rb'"[ \t\r\n:]*"([^"]*)"', raw)
    return m[1].decode("utf-8", "replace").strip() if m and raw.find(b'"' + name + b'"') == m.start() else ""


def aigc_label(raw: bytes) -> str | None:
    """Producer of declared AI content; empty if it names none, None without a label."""
    if _NAMESPACE not in raw:
        ends = ((m.end(), _object_end(raw, m.end())) for m in _LABEL_OBJECT.finditer(raw))
        if not any(end > 0 and b'"ServiceProvider"' in raw[at:end] for at, end in ends):
            return None
    return _field(raw, b"ContentProducer") or _field(raw, b"ServiceProvider")


# -- assessment ---------------------------------------------------------------------


def signals(metadata: Column) -> Column:
    """ARRAY<STRUCT(source, detail, ai)> from metadata records (kind, label, value, ...)."""

    def judge(m):
        tool = generator_of(m["value"])
        named = tool.isNotNull() & (m["label"].isin(*TOOL_FIELDS) | (m["kind"] == "c2pa"))
        source = F.when(m["label"] == "", m["kind"]).otherwise(F.concat_ws(" ", m["kind"], m["label"]))
        detail = F.when(m["value"] == "", _NOTE).otherwise(F.concat(m["value"], F.lit(f", {_NOTE}")))
        one = lambda s, d, ai: F.struct(s.alias("source"), d.alias("detail"), F.lit(ai).alias("ai"))
        return (
            F.when(m["label"] == AIGC, one(F.concat_ws(" ", m["kind"], F.lit(AIGC)), detail, True))
            .when(named, one(source, tool, True))
            .when(m["kind"] == "c2pa", one(F.lit("c2pa"), F.lit("signed credential present"), False))
        )

    return F.filter(F.transform(metadata, judge), lambda s: s.isNotNull())


def confidence(found: Column) -> Column:
    """``likely`` if any signal is of AI, ``possible`` if there is any, else empty."""
    return F.when(F.exists(found, lambda s: s["ai"]), "likely").when(F.size(found) > 0, "possible").otherwise("")


def strips(mode: str, label: str, value: str) -> bool:
    """Whether a record is to be removed under ``none``, ``ai`` or ``all``."""
    if mode == "all":
        return True
    return mode == "ai" and ((label == AIGC and value != "") or generator(value) is not None)
