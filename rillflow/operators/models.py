"""Calls of models for each record, over HTTP from the tasks, or by a function that stands in for one."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from rillflow.operators.base import Op
from rillflow.records import path, plain

__all__ = ["LLM", "DeepSeek", "Embedding", "GoGPT", "LLMModel", "LLMProcessor", "Local", "Moonshot", "Siliconflow"]


def post(url: str, body: dict, api_key: str | None = None, timeout: int = 120, tries: int = 3) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
                return json.load(r)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(2**k)
    raise AssertionError


class LLMModel:
    """A chat service. ``call`` may be given in its place, for tests and for local models."""

    base, name = "", ""

    def __init__(self, api_base: str | None = None, api_key: str | None = None, prompt: str | None = None, model: str | None = None, call: Callable[[str], str] | None = None, remove_think: bool = True, **options):
        self.url, self.key, self.prompt, self.model = api_base or self.base, api_key, prompt, model or self.name
        self.call, self.remove_think, self.options = call, remove_think, options

    def __call__(self, text: str) -> str:
        if self.call:
            return self.call(text)
        answer = post(f"{self.url.rstrip('/')}/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": text}], **self.options}, self.key)
        out = answer["choices"][0]["message"]["content"]
        return out.split("</think>")[-1].strip() if self.remove_think else out


class DeepSeekModel(LLMModel):
    base, name = "https://api.deepseek.com", "deepseek-chat"


class LLMProcessor(Op):
    """The model's answer to a prompt in which {key} stands for fields and {data} for the key's value.

    Errors give null with ignore_errors, so a record is kept.
    """

    def __init__(self, model: LLMModel, prompt: str | None = None, key: str | None = None, target_key: str | None = None, ignore_errors: bool = True):
        self.model, self.prompt, self.key, self.target, self.quiet = model, prompt or model.prompt or "{data}", key, target_key or key or "_answer", ignore_errors

    def __call__(self, df):
        asked = F.lit(self.prompt)
        for c in df.columns:
            if "{" + c + "}" in self.prompt:
                asked = F.replace(asked, F.lit("{" + c + "}"), F.coalesce(plain(c).cast("string"), F.lit("")))
        data = path(df, self.key)[0].cast("string") if self.key else F.to_json(F.struct("*"))
        asked = F.replace(asked, F.lit("{data}"), F.coalesce(data, F.lit("")))
        model, quiet = self.model, self.quiet

        @F.pandas_udf("string")
        def answer(prompts: pd.Series) -> pd.Series:
            def one(p):
                try:
                    return model(p)
                except Exception:
                    if quiet:
                        return None
                    raise

            return prompts.map(one)

        return df.withColumn(self.target, answer(asked))


class LLM(LLMProcessor):
    base, name = "", ""

    def __init__(self, api_base: str | None = None, key: str | None = None, api_key: str | None = None, prompt: str | None = None, model: str | None = None, target_key: str | None = None, ignore_errors: bool = True, call: Callable | None = None, **options):
        super().__init__(LLMModel(api_base or self.base, api_key, prompt, model or self.name, call, **options), prompt, key, target_key, ignore_errors)


class Moonshot(LLM):
    base, name = "https://api.moonshot.cn/v1", "moonshot-v1-8k"


class Siliconflow(LLM):
    base = "https://api.siliconflow.cn/v1"


class DeepSeek(LLM):
    base, name = "https://api.deepseek.com", "deepseek-chat"


class GoGPT(LLM):
    pass


class Embedding(Op):
    """The vector of a text, from a service or a function."""

    def __init__(self, api_base: str, key: str, target_key: str = "_embed", model: str | None = None, call: Callable | None = None):
        self.url, self.key, self.target, self.model, self.call = api_base, key, target_key, model, call

    def __call__(self, df):
        url, model, call = self.url, self.model, self.call

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            if call:
                return texts.map(call)
            return pd.Series([d["embedding"] for d in post(url, {"input": texts.tolist(), "model": model})["data"]])

        return df.withColumn(self.target, embed(path(df, self.key)[0].cast("string")))


Local = Embedding
