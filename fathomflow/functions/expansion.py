"""Expansion of queries that hold Chinese characters: stop words go, known phrases gain synonyms, ASCII words stay.

Everything is a column: a regular expression with the longest phrases first cuts the text into known phrases and single characters, so the
longest match at each place wins; synonyms are looked up in a literal map. Queries without Chinese characters stay as they are."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases with their synonyms, and stop words.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "因子": ("factor", "alpha", "signal"), "动量": ("momentum", "trend"), "反转": ("reversal", "revert"), "价值": ("value",), "质量": ("quality",),
    "波动": ("volatility",), "套利": ("arbitrage",), "高频": ("high frequency", "hft"), "低频": ("low frequency",), "量化": ("quantitative", "quant"),
    "回测": ("backtest", "backtesting"), "时序": ("time series", "temporal", "sequential"), "预测": ("forecast", "prediction", "forecasting"),
    "预训练": ("pretrained", "pre-training", "pretraining"), "基础模型": ("foundation model", "base model"), "生成": ("generative", "generation"), "扩散": ("diffusion",),
    "推荐": ("recommendation", "recommender", "recsys"), "协同": ("collaborative",), "过滤": ("filtering",), "强化学习": ("reinforcement learning", "rl"),
    "深度学习": ("deep learning", "dl"), "注意力": ("attention",), "训练": ("training", "train"), "测试": ("test", "testing"), "数据": ("data", "dataset"),
    "模型": ("model",), "方法": ("method", "approach"), "论文": ("paper",),
}
STOP_WORDS = ("的", "了", "和", "是", "在", "与", "或", "为", "对", "把", "我", "你", "他", "她", "它", "我们", "他们", "什么", "怎么", "如何", "哪些", "是否", "中", "上", "下", "里", "外", "前", "后", "请", "可以", "建议", "需要", "想要")
CHINESE = "[一-鿿]"


def is_chinese(query: Column) -> Column:
    return F.coalesce(F.rlike(query, F.lit(CHINESE)), F.lit(False))


def segments(query: Column, phrases: Sequence[str]) -> Column:
    """ASCII words first, in order, then the known phrases (the longest that begins at a place) and single Chinese characters."""
    longest = "|".join([*map(re.escape, sorted(phrases, key=lambda p: (-len(p), p))), CHINESE])
    return F.concat(*(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)) for pattern in ("[A-Za-z]+", longest)))


def expand(query: Column, longest: bool = False, synonyms: Mapping[str, Sequence[str]] = SYNONYMS, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The query's words and phrases in order, each phrase followed by those of its synonyms that do not stand there yet, without stop words.
    Phrases are of two characters, and single characters alone are stop words; with ``longest``, those of any length count. A null stays null."""
    known = {k: v for k, v in synonyms.items() if longest or len(k) == 2}
    stops = [w for w in stop_words if longest or len(w) == 1]
    empty = F.array().cast("array<string>")
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    kept = F.filter(segments(query, [*known, *(w for w in stops if len(w) > 1)]), lambda s: ~s.isin(*stops))
    more = lambda done, s: F.array_except(F.coalesce(F.element_at(table, s), empty), F.concat(done, F.array(s)))
    grown = F.aggregate(kept, empty, lambda done, s: F.concat(done, F.array(s), more(done, s)))
    return F.when(is_chinese(query), F.array_join(grown, " ")).otherwise(query)
