"""Prompts and answers. Without an endpoint and a key of the caller's own, answers are stubs that show the context."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import strip
from docspark.operators import prompt_ledger

# The texts of prompts and stubs.
SYSTEM_PROMPT = """Ты — интеллектуальный ассистент для анализа документов. 
Отвечай ТОЛЬКО на основе предоставленного контекста.
Если в контексте нет информации для ответа, честно скажи об этом.
НЕ выдумывай факты и НЕ добавляй внешнюю информацию.

Контекст может содержать описания графиков и диаграмм, помеченные [Тип: ...].
Эти описания получены автоматическим анализом изображений из документа.
Используй их для ответов о визуальных элементах (графики, диаграммы, схемы).

Отвечай на том же языке, на котором задан вопрос."""
CHART_PROMPT = """Ты — ассистент для анализа графиков и диаграмм из документов.

Тебе предоставлены данные, полученные автоматическим анализом изображения графика:
- Тип графика (CLIP): %s
- Описание от BLIP (на английском): %s
- Текст, распознанный OCR с изображения: %s

На основе ВСЕХ этих данных напиши подробное описание графика на РУССКОМ языке.
Включи:
1. Тип визуализации
2. Что отображается (какие данные, оси, единицы измерения)
3. Конкретные значения и числа из OCR-текста
4. Основные тренды или выводы (если можно определить)

Если OCR-текст неполный или содержит мусор, используй только достоверную информацию.
Ответ должен быть кратким (3-5 предложений), информативным и на русском языке."""
NO_INDEX = "Индекс не найден. Сначала выполните ingest."

ANSWER = "answer string, model string, context_used string, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"


def user_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Контекст из документа:\n"), context, F.lit("\n\n---\n\nВопрос: "), question, F.lit("\n\nОтвет:"))


def chart_prompt(kind: Column, caption: Column, ocr: Column) -> Column:
    """Recognised text is cut to 500 characters; what is empty says so."""
    return F.format_string(
        CHART_PROMPT,
        kind,
        F.coalesce(F.nullif(caption, F.lit("")), F.lit("(описание недоступно)")),
        F.coalesce(F.nullif(F.substring(ocr, 1, 500), F.lit("")), F.lit("(текст не распознан)")),
    )


def context_used(context: Column) -> Column:
    return F.concat(F.substring(context, 1, 200), F.lit("..."))


def no_usage() -> Column:
    return F.struct(*(F.lit(0).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")))


def stub_answers(asked: DataFrame) -> DataFrame:
    """asked (…, question, context) with an answer that repeats them."""
    text = F.concat(F.lit("[LLM API недоступен — показываю найденный контекст]\n\nВопрос: "), F.col("question"), F.lit("\n\nНайденные фрагменты:\n"), F.col("context"))
    return asked.withColumns({"answer": text, "model": F.lit("stub"), "context_used": context_used(F.col("context")), "usage": no_usage()})


@dataclass(frozen=True)
class Endpoint:
    """A chat endpoint. Nothing is sent anywhere unless the caller gives both url and key."""

    url: str = ""
    key: str = ""
    model: str = "gpt-oss-20b"
    max_tokens: int = 4480
    top_p: float = 0.1
    temperature: float = 0.6
    timeout: float = 60.0
    #: Calls that a task has under way together, further tries of a call, and the wait before the first of them in seconds.
    concurrency: int = 8
    retries: int = 3
    backoff: float = 0.25

    @property
    def usable(self) -> bool:
        return bool(self.url and self.key)

    def available(self, timeout: float = 10.0) -> bool:
        """A small probe from the driver; any failure is no."""
        if not self.usable:
            return False
        try:
            import requests

            body = {"model": self.model, "max_tokens": 5, "messages": [{"role": "user", "content": "ping"}]}
            return requests.post(self.url, headers={"Authorization": self.key}, json=body, timeout=timeout).status_code == 200
        except Exception:
            return False

    def body(self, before: list[dict], prompt: str) -> dict:
        own = {"model": self.model, "max_tokens": self.max_tokens, "top_p": self.top_p, "temperature": self.temperature}
        return own | {"messages": [*before, {"role": "user", "content": prompt}]}

    def send(self, session, before: list[dict], prompt: str) -> str | None:
        """What the endpoint says to one prompt, as JSON text; None after a refusal, or after the last try.

        Tries again after 429, 5xx and broken connections, each time after twice the wait, or as long as the endpoint asks
        for. Calls carry the prompt's hash as an idempotency key, since a task may run again.
        """
        import requests

        headers = {"Accept": "application/json", "Content-Type": "application/json", "Authorization": self.key, "Idempotency-Key": hashlib.sha256(prompt.encode()).hexdigest()}
        for tried in range(self.retries + 1):
            wait = self.backoff * 2**tried
            try:
                got = session.post(self.url, headers=headers, data=json.dumps(self.body(before, prompt)), timeout=self.timeout)
                if got.status_code == 200:
                    return got.text
                if got.status_code != 429 and got.status_code < 500:
                    return None
                asked = got.headers.get("Retry-After", "")
                wait = max(wait, float(asked)) if asked.isdigit() else wait
            except requests.RequestException:
                pass
            if tried < self.retries:
                time.sleep(min(wait, self.timeout))
        return None

    def send_all(self, before: list[dict], prompts: list[str | None]) -> list[str | None]:
        """What is said to each prompt, with at most `concurrency` calls under way; nothing is said to null."""
        import requests

        own = threading.local()

        def one(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            if not hasattr(own, "session"):
                own.session = requests.Session()
            return self.send(own.session, before, prompt)

        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(one, prompts))


def answers(asked: DataFrame, endpoint: Endpoint | None = None, ledger: str | None = None) -> DataFrame:
    """asked (…, question, context) with answers; a failed call gives the stub of its row."""
    if endpoint is None or not endpoint.usable:
        return stub_answers(asked)
    ready = stub_answers(asked).withColumn("__prompt", user_prompt(F.col("context"), F.col("question")))
    said = _said(ready, endpoint, [{"role": "system", "content": SYSTEM_PROMPT}], ledger)
    answer, used = _part("$.choices[0].message.content"), ("prompt_tokens", "completion_tokens", "total_tokens")
    usage = F.struct(*(F.coalesce(_part(f"$.usage.{k}").try_cast("int"), F.lit(0)).alias(k) for k in used))
    told = {"answer": answer, "model": F.lit(endpoint.model), "usage": usage}
    return said.withColumns({k: F.when(answer.isNotNull(), c).otherwise(F.col(k)) for k, c in told.items()}).drop("__said")


def describe_charts(analysed: DataFrame, endpoint: Endpoint | None = None, ledger: str | None = None) -> DataFrame:
    """analysed (…, chart_subtype_ru, blip_caption, ocr_text, gpt_description) with descriptions by the endpoint; without
    one, or after a failed call, the description stays as it is."""
    if endpoint is None or not endpoint.usable:
        return analysed
    ready = analysed.withColumn("__prompt", chart_prompt(F.col("chart_subtype_ru"), F.col("blip_caption"), F.col("ocr_text")))
    text = F.nullif(strip(_part("$.choices[0].message.content")), F.lit(""))
    return _said(ready, endpoint, [], ledger).withColumn("gpt_description", F.coalesce(text, "gpt_description")).drop("__said")


def _part(path: str) -> Column:
    return F.get_json_object("__said", path)


def _said(ready: DataFrame, endpoint: Endpoint, before: list[dict], ledger: str | None) -> DataFrame:
    """ready with __said, what the endpoint says to __prompt, in the place of __prompt; null after a failed call.

    Without a ledger each row's prompt is sent where the row is, whenever the result is worked out. With one the prompts
    are sent now, equal ones once, and only those to which the ledger holds no answer.
    """
    if ledger:
        return prompt_ledger.answered(ready, endpoint, before, ledger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = endpoint.send_all(before, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string())], names=[*batch.schema.names[:-1], "__said"])

    return ready.mapInArrow(run, ready.drop("__prompt").schema.add("__said", "string"))


def no_index(questions: DataFrame) -> DataFrame:
    """The answer where there is no index: no context, no usage."""
    return questions.withColumns({"answer": F.lit(NO_INDEX), "model": F.lit("none"), "context_used": F.lit(None).cast("string")})
