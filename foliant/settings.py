"""Choices of a run: option sets, presets, devices; kept as a small file by the driver."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

LEVELS = (0, 85, 170, 255)
#: Width, height and grey levels of each screen.
DEVICES = {"x4": (480, 800, LEVELS), "x3": (528, 792, LEVELS)}
DEFAULT_DEVICE = "x4"
BUILT_IN = {"quick": "Quick", "full": "Full", "custom": "Custom"}


@dataclass(frozen=True)
class Options:
    grayscale: bool = True
    contrast_boost: bool = True
    quality: int = 70
    remove_fonts: bool = True
    remove_unused_css: bool = True
    light_novel_mode: bool = False
    clean_metadata: bool = True
    text_cleanup: bool = True

    @classmethod
    def full(cls) -> Options:
        return cls()

    @classmethod
    def quick(cls) -> Options:
        return cls(remove_fonts=False, remove_unused_css=False, clean_metadata=False)

    def less(self, **off: bool) -> Options:
        """Flags of a command line: true ones turn an option off, and none turns one on."""
        return replace(self, **{k: getattr(self, k) and not v for k, v in off.items()})

    def processing(self, device: str) -> dict:
        """What the image and text steps read; grey output is quantised."""
        width, height, levels = device_profile(device)
        return asdict(self) | {"width": width, "height": height, "levels": levels, "eink_quantize": self.grayscale}

    def image_options(self, device: str) -> dict:
        keys = ("width", "height", "levels", "grayscale", "eink_quantize", "contrast_boost", "quality", "light_novel_mode")
        return {k: v for k, v in self.processing(device).items() if k in keys}


def device_profile(name: str) -> tuple[int, int, tuple[int, ...]]:
    """Of the named screen, else of the default one."""
    return DEVICES.get(name, DEVICES[DEFAULT_DEVICE])


def devices(spark: SparkSession) -> DataFrame:
    """(id, width, height, gray_levels), the last as their number."""
    return spark.createDataFrame([(k, w, h, len(levels)) for k, (w, h, levels) in DEVICES.items()], "id string, width int, height int, gray_levels int")


@dataclass
class Settings:
    device: str = DEFAULT_DEVICE
    options: Options = field(default_factory=Options.full)
    active: str = "full"
    presets: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Defaults if there is no file; a file that can't be read is an error and never reset."""
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            told = tomllib.load(f)
        known = lambda o: Options(**{k: v for k, v in o.items() if k in Options.__dataclass_fields__})
        presets = [{"id": p["id"], "name": p["name"], "options": known(p.get("options", {}))} for p in told.get("presets", [])]
        return cls(told.get("device", DEFAULT_DEVICE), known(told.get("options", {})), told.get("active", "full"), presets)

    def save(self, path: str) -> None:
        """Written to a file beside it first; folders are made."""
        say = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or c in '"\\' else c for c in v) + '"'
        lines = [f"device = {say(self.device)}", f"active = {say(self.active)}", "", "[options]", *[f"{k} = {say(v)}" for k, v in asdict(self.options).items()]]
        for p in self.presets:
            lines += ["", "[[presets]]", f"id = {say(p['id'])}", f"name = {say(p['name'])}", "", "[presets.options]", *[f"{k} = {say(v)}" for k, v in asdict(p["options"]).items()]]
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        os.replace(path + ".new", path)

    def preset(self, name: str) -> dict:
        found = next((p for p in self.presets if p["id"] == name), None)
        if found is None:
            raise KeyError(f"no preset named '{name}'")
        return found

    def all_presets(self) -> list[tuple[str, str]]:
        """Built-in ones, saved ones, and the free choice last."""
        return [("quick", "Quick"), ("full", "Full"), *[(p["id"], p["name"]) for p in self.presets], ("custom", "Custom")]

    def select(self, name: str) -> None:
        self.options = {"quick": Options.quick(), "full": Options.full(), "custom": self.options}.get(name) or self.preset(name)["options"]
        self.active = name

    def customized(self, options: Options) -> None:
        self.options, self.active = options, "custom"

    def save_preset(self, name: str) -> str:
        """The options under a new id made of the name; taken ones get a number."""
        name = name.strip()
        if not name:
            raise ValueError("a preset needs a name")
        base = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split()) or "preset"
        taken, new, n = set(BUILT_IN) | {p["id"] for p in self.presets}, base, 2
        while new in taken:
            new, n = f"{base}-{n}", n + 1
        self.presets.append({"id": new, "name": name, "options": self.options})
        self.active = new
        return new

    def update_preset(self, name: str) -> None:
        self.preset(name)["options"] = self.options
        self.active = name

    def delete_preset(self, name: str) -> None:
        self.presets.remove(self.preset(name))
        if self.active == name:
            self.active = "custom"

    def label(self) -> str:
        return dict(self.all_presets()).get(self.active, "Custom")
