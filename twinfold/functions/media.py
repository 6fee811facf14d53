"""Media classes, category presets and the screenshot rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions of each preset, and screen resolutions.
EXTENSIONS = {
    "Images": ".jpg .jpeg .png .gif .bmp .webp .tiff .tif .tga .pbm".split(),
    "Videos": ".mp4 .mkv .avi .mov .wmv .flv .webm .m4v .mpg .mpeg .ts .3gp".split(),
    "Audio": ".mp3 .wav .flac .aac .ogg .m4a .wma .opus .aiff .alac".split(),
    "Documents": ".pdf .doc .docx .xls .xlsx .ppt .pptx .txt .rtf .odt .ods .odp .csv .md .epub".split(),
    "Archives": ".zip .rar .7z .tar .gz .bz2 .xz .iso .cab".split(),
}
SCREENS = [
    (1080, 1920), (1080, 2340), (1080, 2400), (1080, 2280), (1080, 2160), (1170, 2532), (1284, 2778), (1179, 2556), (1290, 2796),
    (720, 1280), (750, 1334), (828, 1792), (1125, 2436), (1440, 2560), (1440, 2960), (1440, 3040), (1440, 3200), (1920, 1080),
    (2560, 1440), (3840, 2160), (1366, 768), (1536, 864), (1280, 720), (1600, 900), (2880, 1800), (2560, 1600),
]
#: Parts of names that tell a screenshot.
SCREENSHOT_WORDS = ["screenshot", "screen shot", "screen_", "capture"]


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(EXTENSIONS["Images"])


def is_video(ext: Column) -> Column:
    return F.lower(ext).isin(EXTENSIONS["Videos"])


def media_class(ext: Column) -> Column:
    return F.when(is_image(ext), "Images").when(is_video(ext), "Videos").otherwise("Other")


def extensions_of(categories: list[str], typed: str = "") -> list[str]:
    """Union of presets and a typed list, for an include filter."""
    parts = [p if p.startswith(".") else f".{p}" for p in typed.lower().replace(",", " ").replace(";", " ").split()]
    return sorted({*parts, *(e for c in categories for e in EXTENSIONS[c])})


def is_screenshot(name: Column, ext: Column, width: Column, height: Column) -> Column:
    """By name, or for a png by a screen's resolution either way round."""
    low = F.lower(name)
    named = low.startswith("scr_")
    for w in SCREENSHOT_WORDS:
        named = named | F.contains(low, F.lit(w))
    sizes = sorted({f"{a}x{b}" for w, h in SCREENS for a, b in ((w, h), (h, w))})
    return named | ((F.lower(ext) == ".png") & F.concat(width.cast("string"), F.lit("x"), height.cast("string")).isin(sizes))
