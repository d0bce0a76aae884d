"""Wire dialects (DIA-1..11): requests to neutral conversations and back, responses to text, calls and usage.

Plain Python over one document; ``operators.decode`` applies it to columns in Arrow batches. A dialect is an
object of four functions in ``DIALECTS``; ``register`` adds or replaces one on the driver before it is shipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from swaplens.functions.codec import DecodeError
from swaplens.functions.json_text import MISSING, parse


class Unsupported(ValueError):
    """A request that the neutral form cannot carry."""


@dataclass(frozen=True)
class Dialect:
    name: str
    conversation: Callable[[dict], dict]
    fold: Callable[[list[dict]], dict]
    usage: Callable[[dict], dict]
    request: Callable[[dict, str, int | None, bool], tuple[str, dict]]
    parallel: bool = False
    strict: bool = False
    json_schema: bool = False


def _flat(content, kinds=("text", "input_text", "output_text")) -> str | None:
    """Text of a content that is a string or a list of text parts."""
    if content is None or isinstance(content, str):
        return content
    if not isinstance(content, list):
        raise Unsupported("content is neither text nor parts")
    out = []
    for part in content:
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, dict) and part.get("type", "text") in kinds and isinstance(part.get("text"), str):
            out.append(part["text"])
        else:
            raise Unsupported(f"content part {part.get('type') if isinstance(part, dict) else type(part).__name__}")
    return "".join(out)


def arguments_of(value):
    """Arguments of a call as a value: JSON text parsed, blank as an empty object, other text as it is."""
    if value is None:
        return {}
    if not isinstance(value, str):
        return value
    if not value.strip():
        return {}
    got = parse(value)
    return value if got is MISSING else got


def _int(*values) -> int | None:
    return next((v for v in values if isinstance(v, int) and not isinstance(v, bool)), None)


def _bucket(given, cached, written, output, reasoning) -> dict:
    return {"input": given, "cache_read": cached, "cache_write": written, "output": output, "reasoning": reasoning}


def prompt_total(usage: dict) -> int | None:
    known = [usage[k] for k in ("input", "cache_read", "cache_write") if usage.get(k) is not None]
    return sum(known) if known else None


# --- chat completions (openai, mistral) ------------------------------------------------------------------------------


def _chat_conversation(body: dict) -> dict:
    if (_int(body.get("n")) or 1) > 1:
        raise Unsupported("more than one answer")
    if body.get("functions") or body.get("function_call"):
        raise Unsupported("function calls of the old form")
    system, messages = [], []
    for m in body.get("messages") or []:
        role = m.get("role")
        if role in ("system", "developer"):
            if messages:
                raise Unsupported("a system message after the conversation began")
            system.append(_flat(m.get("content")) or "")
            continue
        kept = {"role": role, "content": _flat(m.get("content"))}
        if role == "assistant" and m.get("tool_calls"):
            kept["tool_calls"] = [{"id": c.get("id"), "name": (c.get("function") or {}).get("name"), "arguments": arguments_of((c.get("function") or {}).get("arguments"))} for c in m["tool_calls"]]
        elif role == "tool":
            kept["tool_call_id"] = m.get("tool_call_id")
        elif role not in ("user", "assistant"):
            raise Unsupported(f"role {role}")
        messages.append(kept)
    tools = []
    for t in body.get("tools") or []:
        if t.get("type", "function") != "function":
            raise Unsupported(f"tool {t.get('type')}")
        tools.append({k: v for k, v in (t.get("function") or {}).items() if k in ("name", "description", "parameters", "strict") and v is not None})
    choice = body.get("tool_choice")
    if isinstance(choice, dict):
        choice = {"name": (choice.get("function") or {}).get("name")}
    return _conversation(body, "\n\n".join(system) if system else None, messages, tools, "required" if choice == "any" else choice, body.get("max_completion_tokens") or body.get("max_tokens"), body.get("response_format"), body.get("parallel_tool_calls"))


def _conversation(body, system, messages, tools, choice, most, form, parallel) -> dict:
    out = {"system": system, "messages": messages, "temperature": body.get("temperature"), "max_tokens": most, "response_format": form, "tools": tools or None, "tool_choice": choice, "parallel_tool_calls": parallel}
    return {k: v for k, v in out.items() if v is not None or k in ("system", "messages")}


def _chat_fold(events: list[dict]) -> dict:
    text, finish, usage, model, calls = [], None, None, None, {}
    for e in events:
        model, usage = e.get("model") or model, e.get("usage") or usage
        for choice in (e.get("choices") or [])[:1]:
            part = choice.get("delta") or choice.get("message") or {}
            text.append(_flat(part.get("content")) or "")
            finish = choice.get("finish_reason") or finish
            for k, c in enumerate(part.get("tool_calls") or []):
                call = calls.setdefault(c.get("index", k), {"id": None, "name": "", "arguments": ""})
                function = c.get("function") or {}
                call["id"], call["name"] = c.get("id") or call["id"], function.get("name") or call["name"]
                given = function.get("arguments")
                call["arguments"] = call["arguments"] + given if isinstance(given, str) else given if given is not None else call["arguments"]
    return {"text": "".join(text), "model": model, "finish_reason": finish, "usage": usage, "calls": [calls[k] for k in sorted(calls)]}


def _chat_usage(u: dict) -> dict:
    given, cached = _int(u.get("prompt_tokens")), _int((u.get("prompt_tokens_details") or {}).get("cached_tokens"))
    own = max(0, given - cached) if given is not None and cached is not None else given
    return _bucket(own, cached, None, _int(u.get("completion_tokens")), _int((u.get("completion_tokens_details") or {}).get("reasoning_tokens")))


def _chat_request(host: str, mistral: bool):
    def build(c: dict, model: str, most: int | None, stream: bool) -> tuple[str, dict]:
        messages = [{"role": "system", "content": c["system"]}] if c.get("system") else []
        made = 0
        for m in c["messages"]:
            out = {"role": m["role"], "content": m.get("content")}
            if m.get("tool_calls"):
                out["tool_calls"] = []
                for call in m["tool_calls"]:
                    made += 1
                    given = call["arguments"]
                    out["tool_calls"].append({"id": call.get("id") or f"call_{made}", "type": "function", "function": {"name": call["name"], "arguments": given if isinstance(given, str) else json.dumps(given)}})
            if m["role"] == "tool":
                out["tool_call_id"] = m.get("tool_call_id")
            messages.append(out)
        body: dict = {"model": model, "messages": messages}
        reasoning = not mistral and model.lower().startswith(("o1", "o3", "o4"))
        if (limit := most or c.get("max_tokens")) is not None:
            body["max_completion_tokens" if reasoning else "max_tokens"] = limit
        if c.get("temperature") is not None and not reasoning:
            body["temperature"] = c["temperature"]
        if c.get("response_format"):
            body["response_format"] = c["response_format"]
        if c.get("tools"):
            body["tools"] = [{"type": "function", "function": {k: v for k, v in t.items() if not (mistral and k == "strict")}} for t in c["tools"]]
        if (choice := c.get("tool_choice")) is not None:
            body["tool_choice"] = {"type": "function", "function": choice} if isinstance(choice, dict) else "any" if mistral and choice == "required" else choice
        if c.get("parallel_tool_calls") is not None and not mistral:
            body["parallel_tool_calls"] = c["parallel_tool_calls"]
        if stream:
            body["stream"] = True
            if not mistral:
                body["stream_options"] = {"include_usage": True}
        return f"https://{host}/v1/chat/completions", body

    return build


# --- messages (anthropic) --------------------------------------------------------------------------------------------


def _blocks_conversation(body: dict) -> dict:
    messages = []
    for m in body.get("messages") or []:
        content = m.get("content")
        if isinstance(content, str) or content is None:
            messages.append({"role": m["role"], "content": content})
            continue
        text, calls, results = [], [], []
        for b in content:
            kind = b.get("type")
            if kind == "text":
                text.append(b.get("text") or "")
            elif kind == "tool_use":
                calls.append({"id": b.get("id"), "name": b.get("name"), "arguments": b.get("input") or {}})
            elif kind == "tool_result":
                results.append({"role": "tool", "tool_call_id": b.get("tool_use_id"), "content": _flat(b.get("content"))})
            else:
                raise Unsupported(f"content block {kind}")
        messages += results
        if text or calls or not results:
            messages.append({"role": m["role"], "content": "".join(text) if text else None, **({"tool_calls": calls} if calls else {})})
    tools = []
    for t in body.get("tools") or []:
        if t.get("type", "custom") != "custom":
            raise Unsupported(f"tool {t.get('type')}")
        tools.append({k: v for k, v in (("name", t.get("name")), ("description", t.get("description")), ("parameters", t.get("input_schema"))) if v is not None})
    choice = body.get("tool_choice") or {}
    kind = choice.get("type")
    return _conversation(body, _flat(body.get("system")) or None, messages, tools, {"name": choice.get("name")} if kind == "tool" else {"any": "required"}.get(kind, kind), body.get("max_tokens"), None, None)


def _blocks_fold(events: list[dict]) -> dict:
    text, finish, usage, model, calls = [], None, {}, None, {}
    for e in events:
        kind = e.get("type")
        if kind == "error":
            raise DecodeError("the stream ends in an error")
        whole = e.get("message") if kind == "message_start" else e if kind == "message" or "content" in e else None
        if whole:
            model = whole.get("model") or model
            usage |= {k: v for k, v in (whole.get("usage") or {}).items() if v is not None}
            finish = whole.get("stop_reason") or finish
            for k, b in enumerate(whole.get("content") or []):
                if b.get("type") == "text":
                    text.append(b.get("text") or "")
                elif b.get("type") == "tool_use":
                    calls[k] = {"id": b.get("id"), "name": b.get("name"), "arguments": b.get("input") or {}}
        elif kind == "content_block_start" and (b := e.get("content_block") or {}).get("type") == "tool_use":
            calls[e.get("index", len(calls))] = {"id": b.get("id"), "name": b.get("name"), "arguments": ""}
        elif kind == "content_block_delta":
            delta = e.get("delta") or {}
            text.append(delta.get("text") or "")
            if "partial_json" in delta and e.get("index") in calls:
                calls[e["index"]]["arguments"] += delta["partial_json"]
        elif kind == "message_delta":
            finish = (e.get("delta") or {}).get("stop_reason") or finish
            usage |= {k: v for k, v in (e.get("usage") or {}).items() if v is not None}
    return {"text": "".join(text), "model": model, "finish_reason": finish, "usage": usage or None, "calls": [calls[k] for k in sorted(calls)]}


def _blocks_usage(u: dict) -> dict:
    return _bucket(_int(u.get("input_tokens")), _int(u.get("cache_read_input_tokens")), _int(u.get("cache_creation_input_tokens")), _int(u.get("output_tokens")), None)


def _blocks_request(c: dict, model: str, most: int | None, stream: bool) -> tuple[str, dict]:
    form, system = c.get("response_format") or {}, c.get("system")
    if form.get("type") == "json_schema":
        raise Unsupported("a JSON schema")
    if form.get("type") == "json_object":
        system = "\n\n".join(x for x in (system, "Answer with one JSON object and no other text.") if x)
    messages: list[dict] = []
    for m in c["messages"]:
        role = "user" if m["role"] in ("user", "tool") else "assistant"
        blocks = []
        if m["role"] == "tool":
            blocks.append({"type": "tool_result", "tool_use_id": m.get("tool_call_id"), "content": m.get("content") or ""})
        elif m.get("content"):
            blocks.append({"type": "text", "text": m["content"]})
        for k, call in enumerate(m.get("tool_calls") or [], 1):
            if not isinstance(call["arguments"], dict):
                raise Unsupported("tool arguments that are no object")
            blocks.append({"type": "tool_use", "id": call.get("id") or f"call_{k}", "name": call["name"], "input": call["arguments"]})
        if messages and messages[-1]["role"] == role:
            messages[-1]["content"] += blocks
        else:
            messages.append({"role": role, "content": blocks})
    body: dict = {"model": model, "messages": messages, "max_tokens": most or c.get("max_tokens") or 4096}
    if system:
        body["system"] = system
    if c.get("temperature") is not None:
        body["temperature"] = c["temperature"]
    if c.get("tools"):
        body["tools"] = [{"name": t["name"], **({"description": t["description"]} if "description" in t else {}), "input_schema": t.get("parameters") or {"type": "object"}} for t in c["tools"]]
        choice = c.get("tool_choice")
        if choice is not None:
            body["tool_choice"] = {"type": "tool", **choice} if isinstance(choice, dict) else {"type": {"required": "any"}.get(choice, choice)}
    if stream:
        body["stream"] = True
    return "https://api.anthropic.com/v1/messages", body


# --- parts (gemini) --------------------------------------------------------------------------------------------------


def _parts_conversation(body: dict) -> dict:
    def text(parts):
        return "".join(p["text"] for p in parts if "text" in p) or None

    messages, config, seen = [], body.get("generationConfig") or {}, 0
    for m in body.get("contents") or []:
        parts = m.get("parts") or []
        if any(not (p.keys() & {"text", "functionCall", "functionResponse"}) for p in parts):
            raise Unsupported("a part that is neither text nor a call")
        calls = [{"id": f"call_{seen + k}", "name": p["functionCall"].get("name"), "arguments": p["functionCall"].get("args") or {}} for k, p in enumerate((p for p in parts if "functionCall" in p), 1)]
        for p in parts:
            if "functionResponse" in p:
                response = p["functionResponse"].get("response")
                first = next((response[k] for k in ("content", "result", "output") if isinstance(response, dict) and isinstance(response.get(k), str)), None)
                messages.append({"role": "tool", "tool_call_id": p["functionResponse"].get("name"), "content": response if isinstance(response, str) else first if first is not None else json.dumps(response)})
        seen += len(calls)
        if calls or text(parts) is not None or not any("functionResponse" in p for p in parts):
            messages.append({"role": "assistant" if m.get("role") == "model" else "user", "content": text(parts), **({"tool_calls": calls} if calls else {})})
    tools = [{k: v for k, v in d.items() if k in ("name", "description", "parameters")} for t in body.get("tools") or [] for d in t.get("functionDeclarations") or []]
    calling = (body.get("toolConfig") or {}).get("functionCallingConfig") or {}
    names = calling.get("allowedFunctionNames") or []
    choice = {"name": names[0]} if len(names) == 1 else {"ANY": "required", "NONE": "none", "AUTO": "auto"}.get(calling.get("mode"))
    form = {"type": "json_object"} if config.get("responseMimeType") == "application/json" else None
    return _conversation(config, text((body.get("systemInstruction") or {}).get("parts") or []), messages, tools, choice, config.get("maxOutputTokens"), form, None)


def _parts_fold(events: list[dict]) -> dict:
    text, finish, usage, model, calls = [], None, None, None, []
    for e in events:
        model, usage = e.get("modelVersion") or model, e.get("usageMetadata") or usage
        for candidate in (e.get("candidates") or [])[:1]:
            finish = candidate.get("finishReason") or finish
            for p in (candidate.get("content") or {}).get("parts") or []:
                if p.get("thought"):
                    continue
                text.append(p.get("text") or "")
                if "functionCall" in p:
                    calls.append({"id": None, "name": p["functionCall"].get("name"), "arguments": p["functionCall"].get("args") or {}})
    return {"text": "".join(text), "model": model, "finish_reason": finish, "usage": usage, "calls": calls}


def _parts_usage(u: dict) -> dict:
    given, cached = _int(u.get("promptTokenCount")), _int(u.get("cachedContentTokenCount"))
    own = max(0, given - cached) if given is not None and cached is not None else given
    return _bucket(own, cached, None, _int(u.get("candidatesTokenCount")), _int(u.get("thoughtsTokenCount")))


def _parts_request(c: dict, model: str, most: int | None, stream: bool) -> tuple[str, dict]:
    names, contents = {}, []
    for m in c["messages"]:
        role, parts = ("model" if m["role"] == "assistant" else "user"), []
        if m["role"] == "tool":
            parts.append({"functionResponse": {"name": names.get(m.get("tool_call_id"), m.get("tool_call_id")), "response": {"content": m.get("content") or ""}}})
        elif m.get("content"):
            parts.append({"text": m["content"]})
        for call in m.get("tool_calls") or []:
            if not isinstance(call["arguments"], dict):
                raise Unsupported("tool arguments that are no object")
            names[call.get("id")] = call["name"]
            parts.append({"functionCall": {"name": call["name"], "args": call["arguments"]}})
        if contents and contents[-1]["role"] == role:
            contents[-1]["parts"] += parts
        else:
            contents.append({"role": role, "parts": parts})
    form = c.get("response_format") or {}
    if form.get("type") == "json_schema":
        raise Unsupported("a JSON schema")
    config = {"temperature": c.get("temperature"), "maxOutputTokens": most or c.get("max_tokens"), "responseMimeType": "application/json" if form.get("type") == "json_object" else None}
    body: dict = {"contents": contents}
    if config := {k: v for k, v in config.items() if v is not None}:
        body["generationConfig"] = config
    if c.get("system"):
        body["systemInstruction"] = {"parts": [{"text": c["system"]}]}
    if c.get("tools"):
        body["tools"] = [{"functionDeclarations": [{k: t[k] for k in ("name", "description", "parameters") if k in t} for t in c["tools"]]}]
        if (choice := c.get("tool_choice")) is not None:
            body["toolConfig"] = {"functionCallingConfig": {"mode": "ANY", "allowedFunctionNames": [choice["name"]]} if isinstance(choice, dict) else {"mode": {"required": "ANY"}.get(choice, choice.upper())}}
    verb = "streamGenerateContent?alt=sse" if stream else "generateContent"
    return f"https://generativelanguage.googleapis.com/v1beta/models/{model}:{verb}", body


DIALECTS: dict[str, Dialect] = {
    "openai": Dialect("openai", _chat_conversation, _chat_fold, _chat_usage, _chat_request("api.openai.com", False), True, True, True),
    "anthropic": Dialect("anthropic", _blocks_conversation, _blocks_fold, _blocks_usage, _blocks_request),
    "gemini": Dialect("gemini", _parts_conversation, _parts_fold, _parts_usage, _parts_request),
    "mistral": Dialect("mistral", _chat_conversation, _chat_fold, _chat_usage, _chat_request("api.mistral.ai", True)),
}


def register(dialect: Dialect) -> None:
    """Adds a dialect or replaces the one of that name; call before queries are built."""
    DIALECTS[dialect.name] = dialect


def events_of(body: str) -> list[dict]:
    """The JSON events of a server-sent stream, without the end mark."""
    out = []
    for frame in body.replace("\r\n", "\n").split("\n\n"):
        lines = [x[5:].removeprefix(" ") if x.startswith("data:") else "" for x in frame.split("\n") if x.startswith("data:") or x == "data"]
        data = "\n".join(lines).strip()
        if data and data != "[DONE]":
            value = parse(data)
            if isinstance(value, dict):
                out.append(value)
    return out


def decode(provider: str, body: str, stream: bool, status: int = 200) -> dict:
    """Text, model, finish reason, usage, streamed and tool calls of a response body; DecodeError if there is none."""
    if status != 200:
        raise DecodeError(f"status {status}")
    if provider not in DIALECTS:
        raise DecodeError(f"no dialect {provider}")
    value = parse(body)
    stream = stream or (value is MISSING and body.lstrip().startswith("data:"))
    if stream:
        events = events_of(body)
    elif isinstance(value, dict):
        events = [value]
    else:
        raise DecodeError("the body is no JSON object")
    if not events:
        raise DecodeError("no events")
    got = DIALECTS[provider].fold(events)
    calls = [{"name": c["name"], "arguments": arguments_of(c["arguments"]), "id": c["id"]} for c in got.pop("calls")]
    return {**got, "provider": provider, "streamed": stream, "tool_calls": calls}
