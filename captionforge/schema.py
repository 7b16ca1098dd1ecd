"""The relations that operators take and return, and the parameters they share.

Every relation is keyed by video_id, the axis of parallelism: windows, folds and aggregates are partitioned by it. Times are
milliseconds from the start of a video. Text that is missing is empty, never null; operators take null for empty.
"""

from __future__ import annotations

from dataclasses import dataclass

FRAMES = "video_id long, frame_no int, path string, ts_ms long"
OCR = "video_id long, ts_ms long, text string"
ATTEMPTS = "video_id long, ts_ms long, ord int, mode string, text string, conf double"
WORDS = "line_id long, pos int, text string, w double, h double"
SUBTITLES = "video_id long, idx int, start_ms long, end_ms long, text string"
ISSUES = "video_id long, idx int, issue_type string, description string"
PIXELS = "img_id long, x int, y int, r int, g int, b int"

CUE = ["video_id", "idx", "start_ms", "end_ms", "text"]


@dataclass(frozen=True)
class DetectorConfig:
    """Similarity that continues a span (before the change by frame rate), shortest normal span, least gap that ends one, shortest text."""

    similarity: float = 0.60
    min_duration: int = 100
    max_gap: int = 1000
    min_length: int = 2


#: Languages by index of the interface, with the tags that recognisers take. (Fixed values.)
LANGUAGES = {0: ("chi_sim", "zh-Hans"), 1: ("chi_tra", "zh-Hant"), 2: ("eng", "en-US"), 3: ("jpn", "ja-JP"), 4: ("kor", "ko-KR"), 5: ("vie", "vi-VN")}
#: Preprocessing modes by index. (Fixed values.)
MODES = {0: "Auto", 1: "Otsu", 2: "Adaptive", 3: "ColorBased", 4: "Invert"}


def language(index: int, tag: bool = False) -> str:
    """The language of an index. One that isn't known is chi_sim by name; a recogniser has no tag for it."""
    if index not in LANGUAGES:
        if tag:
            raise ValueError(f"there is no language {index}")
        return "chi_sim"
    return LANGUAGES[index][tag]


def preprocess_mode(index: int) -> str:
    return MODES.get(index, "Auto")


def low_fps_warning(fps: int) -> bool:
    """Whether so few frames per second are likely to miss subtitles."""
    return fps < 3
