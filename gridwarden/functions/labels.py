"""What headers and row labels say, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and markers of headers and summary rows.
IDENTIFIER_WORDS = "code id identifier iban imei imsi isbn key ssn sku vin zip".split()
NUMBER_WORDS = "number no num".split()
NUMBERED_THINGS = (
    "account bank card claim contract credit customer employee invoice license member mobile order passport phone policy product record reference routing security serial social telephone vendor"
).split()
IDENTIFIER_MARKERS = "标识 编号 编码 代码 号码 账号 帐号 手机号 电话 身份证 证件 银行卡 卡号 社保 护照 单号 工号 学号 邮编".split()
MEASURE_WORDS = "amount balance cost count duration hours length limit margin measure price quantity rate revenue score tax total units value volume weight".split()
MEASURE_MARKERS = "金额 余额 价格 单价 成本 数量 数额 费用 税额 税率 收入 营收 时长 小时 长度 重量 比率 比例 分数 得分 上限 限额 额度 容量 体积".split()
SUMMARY = (
    r"(?i)(?<![A-Z0-9_])(?:(?:grand|sub)[\s-]+total|subtotal|total|average|avg|mean|minimum|maximum|min|max|median|summary|ending[\s-]+balance|closing[\s-]+balance|net[\s-]+amount|adjustment|override|manual[\s-]+override)(?![A-Z0-9_])"
    r"|(?:合计|总计|小计|汇总|平均|均值|最大|最小|中位数|总金额|累计|净额|期末余额|期初余额|调整项|调整|手工覆盖|人工覆盖)"
)
OVERRIDE = r"(?i)adjustment|override|调整|覆盖"


def words_of(header: Column) -> Column:
    return F.split(F.lower(F.trim(header)), "[^a-z0-9]+")


def any_of(words: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def identifier_header(header: Column) -> Column:
    """Whether a header names identifiers: a marker, a word, or a number of something that is numbered. Null doesn't."""
    words = words_of(header)
    numbered = any_of(words, NUMBER_WORDS) & any_of(words, NUMBERED_THINGS)
    return F.coalesce(header.rlike("|".join(IDENTIFIER_MARKERS)) | any_of(words, IDENTIFIER_WORDS) | numbered, F.lit(False))


def measure_header(header: Column) -> Column:
    """Whether a header names something measured; null doesn't."""
    return F.coalesce(header.rlike("|".join(MEASURE_MARKERS)) | any_of(words_of(header), MEASURE_WORDS), F.lit(False))


def summary_label(text: Column, overrides: bool = True) -> Column:
    """Whether a text labels a summary row; those of manual changes only if overrides."""
    hit = F.trim(text).rlike(SUMMARY)
    return F.coalesce(hit if overrides else hit & ~text.rlike(OVERRIDE), F.lit(False))


def template(label: str) -> str:
    """What labels of one kind share: compatible forms unified, case folded, numbers and white space made alike."""
    plain = unicodedata.normalize("NFKC", label).strip().casefold()
    return " ".join(re.sub(r"\d+", "<n>", plain).split())


def label_template(labels: Column) -> Column:
    """template() of each label; null for null. Neither NFKC nor case folding is a function of the engine."""

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([template(x) if x is not None else None for x in texts], dtype=object)

    return F.pandas_udf(made, "string")(labels)
