"""Identity of interactions and prompts (ID-1..15): Column expressions, with plain Python where JSON is arbitrary."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

MIGRATION, JUDGE, IMPORTED = "migration__", "judge__", "imported__"
KEY_VERSION = 1
#: Host part -> provider, and model prefixes, in the order they are tried.
HOSTS = (("mistral", "mistral"), ("generativelanguage", "gemini"), ("anthropic", "anthropic"), ("openai", "openai"))
MODEL_PREFIXES = (
    ("mistral", ("mistral-", "ministral-", "codestral-", "pixtral-", "magistral-", "devstral-", "open-mistral-", "open-mixtral-")),
    ("gemini", ("gemini-", "gemini")),
    ("anthropic", ("claude-",)),
    ("openai", ("gpt-", "chatgpt-", "o1", "o3", "o4")),
)
#: Request fields that say how to send or sample, not what is asked.
TRANSPORT_FIELDS = ("stream", "stream_options", "model")
SAMPLING_FIELDS = ("temperature", "top_p", "top_k", "max_tokens", "max_completion_tokens", "seed", "user", "metadata", "frequency_penalty", "presence_penalty", "logit_bias", "logprobs", "top_logprobs", "service_tier", "store")


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and the spelling of numbers kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest_text(*parts: str) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part.encode("utf-8", "surrogatepass") + b"\0")
    return h.hexdigest()


def digest(*parts: Column) -> Column:
    """Hex SHA-256 over the parts, each followed by a NUL byte."""
    pieces = [p for part in parts for p in (part.cast("binary"), F.unhex(F.lit("00")))]
    return F.sha2(F.concat(*pieces), 256)


def sanitize(text: Column) -> Column:
    """Runs of other characters than letters, digits, ``._-`` as one dash; ``x`` if nothing is left."""
    dashed = F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("x"))


def sanitize_text(text: str) -> str:
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-") or "x"


def migration_id(baseline: Column, model: Column) -> Column:
    return F.concat(F.lit(MIGRATION), baseline, F.lit("__to__"), sanitize(model))


def judge_id(model: Column, base: Column, target: Column) -> Column:
    return F.concat(F.lit(JUDGE), sanitize(model), F.lit("__"), F.left(digest(model, base, target), F.lit(32)))


def import_id(source: Column, record: Column, cassette: Column) -> Column:
    own = F.when(record.isNotNull() & (record != ""), sanitize(record))
    return F.concat(F.lit(IMPORTED), source, F.lit("__"), F.coalesce(own, F.right(cassette, F.lit(16))))


def file_stem(name: Column) -> Column:
    """Safe file name of an id: changed names carry eight digits of the id's hash."""
    safe = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    return F.when(safe == name, name).otherwise(F.concat(safe, F.lit("-"), F.left(F.sha2(name.cast("binary"), 256), F.lit(8))))


def call_id(text: Column) -> Column:
    """A tool call id of nine letters or digits: itself, or the start of its SHA-1."""
    return F.when(text.rlike("^[A-Za-z0-9]{9}$"), text).otherwise(F.left(F.sha1(text.cast("binary")), F.lit(9)))


def provider_of_url(url: Column) -> Column:
    """The provider whose host part occurs in the host; else the host; else ``unknown``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    out = F.when(host == "", F.lit("unknown"))
    for part, name in HOSTS:
        out = out.when(host.contains(part), F.lit(name))
    return F.coalesce(out.otherwise(host), F.lit("unknown"))


def provider_of_model(model: Column) -> Column:
    """The provider whose prefix the model starts with, or null."""
    low, out = F.lower(model), F.lit(None).cast("string")
    for name, prefixes in reversed(MODEL_PREFIXES):
        for prefix in prefixes:
            out = F.when(low.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def provider_of_name(model: str) -> str | None:
    """As ``provider_of_model``, for one name."""
    return next((name for name, prefixes in MODEL_PREFIXES if model.lower().startswith(tuple(prefixes))), None)


def conversation_key(system: Column, messages: Column) -> Column:
    """Semantic key of a conversation without tools: ``messages`` is an array of (role, content)."""
    plain = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    body = F.to_json(F.struct(plain.alias("messages"), system.alias("system")), {"ignoreNullFields": "false"})
    return F.left(digest(F.lit("conversation"), body), F.lit(32))


def conversation_key_of(conversation: dict) -> str:
    """The same for any conversation: system, messages (role, content, tool calls), tools, tool choice."""
    messages = []
    for m in conversation.get("messages") or []:
        kept = {"role": m.get("role"), "content": m.get("content")}
        if m.get("tool_calls"):
            kept["tool_calls"] = [{"name": c.get("name"), "arguments": c.get("arguments")} for c in m["tool_calls"]]
        messages.append(kept)
    body = {"system": conversation.get("system"), "messages": messages}
    if conversation.get("tools"):
        body["tools"] = [{k: t[k] for k in ("name", "description", "parameters") if k in t} for t in conversation["tools"]]
    if conversation.get("tool_choice") not in (None, "auto"):
        body["tool_choice"] = conversation["tool_choice"]
    return digest_text("conversation", canonical(body))[:32]


def fallback_key(method: str, url: str, content: str) -> str:
    """Key of a request that no dialect can translate."""
    try:
        body = json.loads(content)
    except ValueError:
        return digest_text(method, urlsplit(url).path, content)[:32]
    if isinstance(body, dict):
        body = {k: v for k, v in body.items() if k not in TRANSPORT_FIELDS and k not in SAMPLING_FIELDS}
    return digest_text(method, urlsplit(url).path, canonical(body))[:32]


def cassette_id_of(provider: str, model: str | None, method: str, url: str, content: str) -> str:
    try:
        body = json.loads(content)
        text = canonical({k: v for k, v in body.items() if k not in TRANSPORT_FIELDS} if isinstance(body, dict) else body)
    except ValueError:
        text = content
    return f"{sanitize_text(provider)}_{sanitize_text(model or 'unknown')}_{digest_text(method, urlsplit(url).path, str(model), text)[:16]}"
