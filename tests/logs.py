"""Hand-made lines of logs that several tests write."""

import json


def call(msg, ts, model="claude-opus-4-7", cwd=None, **usage):
    names = {"i": "input_tokens", "o": "output_tokens", "r": "cache_read_input_tokens", "w": "cache_creation_input_tokens"}
    counts = {names[k]: v for k, v in usage.items() if k in names} | ({"cache_creation": {"ephemeral_1h_input_tokens": usage["h"]}} if "h" in usage else {})
    message = {"role": "assistant", "model": model, "content": [{"type": "text", "text": "x"}], "usage": counts}
    return {"type": "assistant", "timestamp": ts, "message": message | ({"id": msg} if msg else {})} | ({"cwd": cwd} if cwd else {})


def said(ts, text="go", **more):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": text}} | more


def write(folder, name, lines, mode="w"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.write("".join(json.dumps(x) + "\n" if isinstance(x, dict) else x + "\n" for x in lines))
