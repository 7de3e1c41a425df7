"""Page specifications, samples and options."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masking import checked, default_categories

SAMPLE_PAGES = 12


def parse_pages(spec: Column, total: Column) -> Column:
    """'3,7,11-13' as sorted distinct numbers from 1 to total; an empty spec means all."""
    part = lambda p: F.struct(F.try_to_number(F.regexp_extract(p, r"^\s*(\d+)", 1), F.lit("999999999")).cast("int").alias("a"), F.try_to_number(F.regexp_extract(p, r"(\d+)\s*$", 1), F.lit("999999999")).cast("int").alias("b"))
    ranges = F.transform(F.filter(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: p.rlike(r"\d")), part)
    # A descending range is empty; sequence() would count down.
    runs = F.transform(ranges, lambda r: F.when(r["a"] <= F.least(r["b"], total), F.sequence(F.greatest(r["a"], F.lit(1)), F.greatest(F.least(r["b"], total), F.lit(1)))).otherwise(F.array().cast("array<int>")))
    listed = F.array_sort(F.array_distinct(F.filter(F.flatten(runs), lambda n: n.between(1, total))))
    everything = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(F.trim(F.coalesce(spec, F.lit(""))) == "", everything).otherwise(listed)


def sampled(page: Column, count: Column, sample: int = SAMPLE_PAGES) -> Column:
    """Whether a page (from 1) is in the systematic sample."""
    step = F.greatest(F.lit(1), F.floor(count / sample))
    return (F.pmod(page - 1, step) == 0) & ((page - 1) / step < sample)


@dataclass(frozen=True)
class Options:
    """Settings of a conversion; they become literals when a plan is built."""

    dpi: int = 110
    image_format: str = "jpg"
    preview_dpi: int = 96
    margin_top: float = 0.0
    margin_bottom: float = 0.0
    write_images: bool = True
    ignore_images: bool = False
    ignore_graphics: bool = False
    force_text: bool = True
    table_strategy: str = "lines_strict"
    figure_legends: bool = True
    page_separators: bool = True
    heading_mode: str = "hybrid"
    emphasis: str = "auto"
    previews: bool = True
    speaker_notes: bool = True
    anonymize: tuple[str, ...] = tuple(default_categories())

    @classmethod
    def of(cls, settings: dict) -> Options:
        """Unknown settings are dropped, unknown categories an error."""
        known = {f.name for f in fields(cls)}
        made = cls(**{k: tuple(v) if k == "anonymize" else v for k, v in settings.items() if k in known})
        checked(made.anonymize)
        return made


#: Figure presets of the review screen.
FIGURE_PRESETS = {
    "compact": {"dpi": 110, "image_format": "jpg", "ignore_images": False},
    "sharp": {"dpi": 150, "image_format": "png", "ignore_images": False},
    "none": {"ignore_images": True, "write_images": False},
}
