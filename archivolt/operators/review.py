"""Routes of pages and tasks: the second reader, the merge of two readers, and human review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions.text import coerced, compact

# Thresholds, words of issues, and the states and reasons of a review.
REVIEW_LOW, REVIEW_HIGH, SECOND_READER, PREPROCESS = 0.60, 0.85, 0.45, 0.35
LEGIBILITY = ("模糊", "不清", "看不清", "难辨", "难以辨认", "无法辨认", "字迹", "签名", "签字", "盖章", "印章", "手写", "遮挡", "污损", "重影", "过曝", "欠曝", "残缺", "缺角", "截断", "裁切")
OPTIONAL_FIELDS = ("档号", "文号", "责任者", "题名", "日期", "页数", "密级", "备注", "负责人")
ABSENCE = ("缺失", "为空", "空白", "留空", "均缺失", "未提取", "未抽取", "未识别", "未发现", "缺少", "没有", "无")
HARMLESS = ("需规范化", "已规范化", "无需人工复核", "无需人工审核", "不视为问题")
BLOCKING = ("冲突", "不一致", "矛盾", "失败", "错误", "异常", "中断", "无法判断", "无法确认", "无法核定", "需要人工", "需人工", "待人工", "人工复核", "人工审核")
NO_RESULT = r"^(Vision LLM|PaddleOCR-VL-1\.5|PP-OCR-VL) 未返回可用结果"
NOT_AVAILABLE = r"(?is)^(?=.*(vision llm|pp-ocr-vl|paddleocr-vl))(?=.*(unavailable|not configured))"
NO_TEXT = r"^(传统 OCR|PaddleOCR-VL-1\.5) 未提取到有效文本。$"
CONFLICT_REASON, LOW_REASON, BAND_REASON = "跨页关键字段冲突：", "总体置信度 %s 低于 0.60", "总体置信度 %s 落在人工审核区间"


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def illegible(c: Column) -> Column:
    """F-18: the issue is about legibility."""
    return _has(coerced(c), LEGIBILITY)


def optional_absence(c: Column) -> Column:
    """F-18: the issue only says that an archive field is absent."""
    return ~illegible(c) & _has(coerced(c), OPTIONAL_FIELDS) & _has(coerced(c), ABSENCE)


def operational(c: Column) -> Column:
    """F-18: the issue does not count for a review."""
    t = coerced(c)
    confidence_only = t.contains("置信度") & t.contains("低于阈值") & t.contains("人工复核") & ~illegible(c)
    return t.rlike(NO_RESULT) | t.rlike(NOT_AVAILABLE) | t.rlike(NO_TEXT) | _has(t, HARMLESS) | confidence_only | optional_absence(c)


def blocking(c: Column) -> Column:
    """F-18: the issue asks for a review. Null and blank issues do not."""
    return ~operational(c) & (illegible(c) | _has(coerced(c), BLOCKING))


def confidence(c: Column) -> Column:
    """A confidence between 0 and 1 with four digits; null is 0."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0)))), 4)


def two_digits(c: Column) -> Column:
    """A number from 0 to 1 with two digits, as its binary value says: 0.835 is a little less than that, so 0.83 (Java's formats go by the shortest decimal text, 0.84).

    Its multiple of 2^62 is a whole number for what is not below 2^-10, so hundredths and halves (to even) are told exactly.
    """
    whole = (c * float(1 << 62)).cast("long").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    one = F.lit(1 << 62).cast("decimal(20,0)")
    down = F.floor((c * 100 - 0.25).cast("double")).cast("long")
    down = F.greatest(F.lit(0).cast("long"), down)
    rest = (whole - down.cast("decimal(5,0)") * one) * F.lit(2).cast("decimal(1,0)")
    near = F.when((rest > one) | ((rest == one) & (down % 2 == 1)), down + 1).otherwise(down)
    return F.format_string("%d.%02d", (near / 100).cast("long"), near % 100)


def review_route(conflicts: Column, issues: Column, overall: Column) -> dict[str, Column]:
    """G-15: human_review, review_status and review_reason of a task.

    Conflicting fields and blocking issues ask for a review; low confidence alone never does. Null arrays are empty.
    """
    none, c = F.array().cast("array<string>"), confidence(overall)
    conflicts = F.coalesce(conflicts, none)
    stopping = F.filter(F.transform(F.coalesce(issues, none), coerced), blocking)
    review, clash = (F.size(conflicts) > 0) | (F.size(stopping) > 0), F.size(conflicts) > 0
    status = F.when(~review, "approved").when(clash | (c >= REVIEW_LOW), "pending_human_review").otherwise("required")
    said = F.when(c < REVIEW_LOW, F.format_string(LOW_REASON, two_digits(c))).when(c <= REVIEW_HIGH, F.format_string(BAND_REASON, two_digits(c)))
    parts = F.array(F.when(clash, F.concat(F.lit(CONFLICT_REASON), F.array_join(conflicts, ", "))), F.get(stopping, F.lit(0)), F.when(review, said))
    reason = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), "；")
    return {"human_review": review, "review_status": status, "review_reason": reason}


def page_route(mode: Column, complexity: Column, retries: Column, strategy: Column, shared: bool = False) -> dict[str, Column]:
    """G-11: whether a second reader reads the page, and how the page is prepared.

    shared: both readers are one remote service, so that a second reading would say nothing new.
    """
    second = F.lit(not shared) & (mode.isin("vl", "baidu_vl") | (F.coalesce(retries, F.lit(0)) > 0) | (complexity >= SECOND_READER))
    chosen = F.coalesce(F.nullif(coerced(strategy), F.lit("")), F.lit("none"))
    prepare = (chosen == "none") & mode.isin("layout", "ocr") & (complexity >= PREPROCESS)
    return {"second_reader": second, "strategy": F.when(prepare, "opencv_document").otherwise(chosen)}


def two_readers(left: Column, right: Column, left_confidence: Column, right_confidence: Column) -> Column:
    """G-12: a field of two readers; if they differ, the more confident one's, the left one's in a tie."""
    a, b, x, y = coerced(left), coerced(right), confidence(left_confidence), confidence(right_confidence)
    differ = (a != "") & (b != "") & (compact(a) != compact(b))
    return F.when(differ & (x < y), b).when(a != "", a).otherwise(b)


def two_confidences(left: Column, right: Column) -> dict[str, Column]:
    """G-12: confidence and source of two readers together."""
    x, y = confidence(left), confidence(right)
    both = (x > 0) & (y > 0)
    joint = F.when(both, F.round(F.least(F.lit(1.0), x * 0.45 + y * 0.55), 4)).otherwise(F.greatest(x, y, F.lit(0.35)))
    return {"confidence": joint, "source": F.when(both, "hybrid").when(x >= y, "ocr").otherwise("ppocr_vl")}


def corrected(old: Column, new: Column) -> Column:
    """G-16: a person's correction, if it is not blank."""
    return F.coalesce(F.nullif(coerced(new), F.lit("")), old)
