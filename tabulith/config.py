"""All thresholds in one place, as multiples of a page's statistics or ratios."""

from __future__ import annotations

import hashlib
import json

# Fixed values.
DEFAULTS: dict = {
    "page_stats": {
        "k_neighbours": 5, "angle_cone_deg": 30.0, "n_bins": 64, "range_quantile": 0.95, "smoothing_bins": 3, "min_tokens": 24,
        "min_peak_mass": 0.06, "vertical_dominance": 1.5, "min_pair_overlap": 0.5, "min_pitch_size_ratio": 0.9,
        "max_pitch_size_ratio": 3.0, "max_word_gap_size_ratio": 0.8,
    },
    "page_typing": {"digital_min_chars": 200, "raster_max_chars": 20, "raster_min_image_coverage": 0.75, "hybrid_min_image_coverage": 0.3, "coverage_grid": 128},
    "rules": {"max_thickness": 0.25, "min_length": 1.5, "merge_tolerance": 0.12, "dedupe": 0.15, "link_y": 0.35, "link_x": 0.35},
    "lines": {"min_vertical_overlap": 0.45, "max_centre_offset": 0.6},
    "blocks": {"prose_min_width_share": 0.5, "split": 1.6, "rule_clearance": 0.25},
    "columns": {
        "gutter_persistence": 0.8, "min_gutter": 2.2, "token_pad": 0.6, "bin": 0.25, "agreement": 2.5, "run_max_gap": 3.0,
        "merge_min_support": 0.98, "unit_from_font_size": 0.3, "unit_from_line_pitch": 0.2, "rule_block_overlap_min": 0.7,
        "alignment_ratio": 1.8, "alignment_tolerance": 0.5, "gutter_respect_share": 0.7, "spanning_max_indent": 8.0,
        "min_support": 0.95, "symbol_max_width_share": 0.045, "symbol_min_purity": 0.8, "max_bins": 20_000,
    },
    "rows": {
        "total_words_strong": ["total", "subtotal", "sub-total", "grand total", "aggregate"],
        "total_words_weak": ["net ", "gross ", "profit ", "loss ", "balance at", "closing balance", "ending balance"],
        "wrap_max_gap": 1.4, "row_rule_min_width_share": 0.6, "wrap_min_indent": 0.5, "indent_step": 1.5, "max_indent_levels": 4,
        "centred_min_margin": 4.0, "centred_symmetry_ratio": 0.25,
    },
    "traps": {
        "row_share": 0.6, "prose_mean_words": 8.0, "prose_max_numeric_share": 0.05, "keyvalue_max_rows": 3, "min_rows": 2,
        "fragment_max_rows": 3, "fragment_gap": 5.0, "fragment_column_tol": 4.0,
    },
    "furniture": {"edge_line_depth": 3, "min_page_share": 0.4, "min_pages": 3},
    "values": {"min_type_agreement": 0.7},
    "confidence": {
        "base": 0.95, "floor": 0.05, "type_nonconformity": 0.45, "source_error": 0.6, "parse_ambiguous": 0.35, "unit_ambiguous": 0.15,
        "crossfoot_fail": 0.4, "table_flag": 0.1, "low_confidence_layout": 0.15, "header_split": 0.5, "crossfoot_pass": 0.04,
        "crossfoot_tolerance": 0.02, "review_threshold": 0.9, "apply_calibration": True,
    },
    "workbook": {"native_type_min_confidence": 0.9},
    "context": {
        "title_max_pitch": 4.0, "caption_max_pitch": 4.0, "unit_local_pitch": 2.0, "heading_size": 1.05, "max_title_words": 16,
        "max_caption_words": 20, "max_section_depth": 4,
    },
    "assets": {"min_page_share": 0.4, "min_pages": 3, "furniture_iou": 0.95, "min_area_share": 0.02, "adjacency_pitch": 2.0},
    "spans": {"min_overlap_share": 0.35, "max_header_rows": 4, "header_max_numeric_share": 0.25, "header_merge_gap": 3.0},
    "stitch": {"max_edge_share": 0.015, "top_margin_pitch": 1.5, "header_similarity": 0.9},
    "footnotes": {"search_pages_ahead": 2},
    "ocr": {"min_text_tokens": 24, "dpi": 300},
}


class Config:
    """Dotted access; a missing key is an error, never a silent default."""

    def __init__(self, data: dict | None = None):
        self.data = DEFAULTS if data is None else data

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(yaml.safe_load(f))

    def get(self, key: str):
        at = self.data
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                raise KeyError(f"no setting {key!r}")
            at = at[part]
        return at

    def f(self, key: str) -> float:
        return float(self.get(key))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


CONFIG = Config()
