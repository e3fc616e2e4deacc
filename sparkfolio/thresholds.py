"""All numbers that decide a result, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # They have to equal those of the layouts that results are compared with.
    image_page_coverage: float = 0.45
    kana_least: int = 2
    hangul_least: int = 2
    han_least: int = 6
    han_share: float = 0.12
    latin_few: int = 8
    latin_least: int = 5
    language_pages: int = 5
    language_chars: int = 12_000
    typing_overlap: float = 0.5
    tall_ratio: float = 1.25
    orientation_boxes: int = 6
    orientation_vertical: float = 0.55
    orientation_confidence: float = 0.80
    orientation_horizontal: float = 0.35
    score_confidence: float = 0.75
    score_horizontal: float = 0.25
    layer_coverage: float = 0.78
    layer_duplication: float = 1.25
    band_near: float = 0.03
    band_extension: float = 0.008
    chunk_slots: int = 8
    chunk_chars: int = 240
    heading_chars: int = 64
    heading_label_chars: int = 24
    body_top: float = 0.10
    body_width: float = 0.22
    body_visual_overlap: float = 0.08
    heading_gap: float = 0.04
    heading_shift: float = 0.08
    caption_overlap: float = 0.25
    caption_above: float = 0.04
    caption_below: float = 0.015
    neighbour_overlap: float = 0.08
    duplicate_overlap: float = 0.90
    wrapper_children: int = 2
    wrapper_cover: float = 0.60
    rhythm_gap: float = 11.25
    rhythm_least_gap: float = 4.5
    body_font: float = 9.0
    line_height: float = 1.25
    cell_padding_x: float = 2.5
    cell_padding_y: float = 0.7
    column_least: float = 34.0
    column_cap: float = 190.0
    span_most: int = 100
    merge_overlap: float = 0.65
    merge_gap: float = 0.03
    line_tolerance: float = 0.55
    line_tolerance_least: float = 4.0
    line_tolerance_most: float = 14.0
    cluster_gap: float = 16.0
    qa_latin: int = 20
    qa_latin_cjk: int = 3
    qa_cjk: int = 5
    qa_cjk_latin: int = 10
    qa_similarity: float = 0.97
    bilingual_points: float = 2.0
    bilingual_width: float = 1.8
    page_points: float = 0.1
    spec_size: float = 0.2
    spec_bounds: float = 0.5
    similarity_chars: int = 20_000


T = Thresholds()
