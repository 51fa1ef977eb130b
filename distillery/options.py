"""Option dataclasses and the fixed values results depend on.

The values under "Fixed values" must stay exactly as written: prompts,
message texts and markers are part of the produced bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; do not edit)
# ---------------------------------------------------------------------------

# Teacher system prompt as the folded YAML scalar reads: the two source lines
# are joined by one space (hence "Guid e.") and the text ends with a newline.
TEACHER_SYSTEM_PROMPT = (
    "You are a senior Python developer skilled at writing comprehensive "
    "docstrings following the Google Python Style Guid e. Your task is to add "
    "clear, precise, and professional Google-style docstrings to the provided "
    "Python code.\n"
)
# Assistant / student system prompt: no trailing newline.
ASSISTANT_SYSTEM_PROMPT = "You are a senior Python developer."
# System message of a batch request line, sent with the role "developer".
BATCH_DEVELOPER_PROMPT = "You are a Python Developer."
BATCH_METHOD = "POST"
BATCH_URL = "/v1/chat/completions"
BATCH_MODEL = "gpt-3.5-turbo"
BATCH_TEMPERATURE = 0.7
BATCH_TOP_P = 0.9
REQUEST_ID_PREFIX = "request-"
ERROR_MARK = "[ERROR] => "
NO_CONTENT_MARK = "[No content]"
UNKNOWN_ID_TEMPLATE = "[Batch custom_id={}]"
GENERATION_ERROR_MARK = "[OpenAI API Error] => "
SPECIAL_TOKENS = ["<|im_end|>"]
PAD_TOKEN = "<|im_end|>"
UNK_TOKEN = "<unk>"
IGNORE_INDEX = -100
# (teacher kind, size) -> dataset revision.
VERSION_MAP = [
    ("open", "16k", "v3-GoogleDocString"),
    ("open", "32k", "v5-GoogleDocString"),
    ("open", "64k", "v7-GoogleDocString"),
    ("closed", "16k", "v3-NumpyDocString"),
    ("closed", "32k", "v5-NumpyDocString"),
    ("closed", "64k", "v7-NumpyDocString"),
]
# Configured defaults.
PROMPT_WORD_LIMIT = 17
PROMPT_WORD_LIMIT_DEFAULT = 29
SFT_SPLIT_SEED = 19
KD_SPLIT_SEED = 42
TEST_SIZE = 0.1
SFT_MAX_LENGTH = 1024
KD_MAX_LENGTH = 512
KD_TEMPERATURE = 0.5
KD_WEIGHT = 0.3
KD_WEIGHT_DEFAULT = 0.5
GEN_TEMPERATURE = 0.5
GEN_TOP_P = 0.95
GEN_TOP_K = 100
GEN_BATCH_SIZE = 256
BATCH_FILE_SIZE = 1024
SFT_BATCH_SIZE = 8
KD_BATCH_SIZE = 12
SYSTEM_PROMPT_MIN_CHARS = 20
SYSTEM_PROMPT_MAX_CHARS = 1024


# ---------------------------------------------------------------------------
# Options
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RegistryEntry:
    """One dataset of the registry: name, key column, subset, local path and
    its format (``json`` or ``parquet``; by default told from the suffix)."""

    name: str
    key: str | None = "instruction"
    subset: str | None = None
    external_local_path: str | None = None
    external_format: str | None = None


@dataclass(frozen=True)
class LossOptions:
    temperature: float = KD_TEMPERATURE
    reduction: str = "batchmean"
    weight: float = KD_WEIGHT

    def __post_init__(self):
        # the loss configuration bounds T to (0, 1]; T = 0 would divide by zero
        if not 0 < self.temperature <= 1.0:
            raise ValueError("loss temperature must be within (0, 1]")
        if self.reduction not in ("batchmean", "sum", "mean", "none"):
            raise ValueError(f"unknown reduction {self.reduction!r}")
        if not 0.0 <= self.weight <= 1.0:
            raise ValueError("weight must be within [0, 1]")


@dataclass(frozen=True)
class SamplingOptions:
    temperature: float = GEN_TEMPERATURE
    top_k: int = GEN_TOP_K
    top_p: float = GEN_TOP_P
    do_sample: bool = True
    seed: int = 0

    def __post_init__(self):
        if not self.temperature > 0:
            raise ValueError("temperature must be > 0")
        if self.top_k < 0:
            raise ValueError("top_k must be >= 0")
        if not 0.0 < self.top_p <= 1.0:
            raise ValueError("top_p must be within (0, 1]")


@dataclass(frozen=True)
class SplitOptions:
    test_size: float = TEST_SIZE
    seed: int = SFT_SPLIT_SEED

    def __post_init__(self):
        if not 0.0 < self.test_size < 1.0:
            raise ValueError("test_size must be within (0, 1)")
        if not self.seed > 0:
            raise ValueError("seed must be > 0")


@dataclass(frozen=True)
class TokenizerOptions:
    max_length: int | None = SFT_MAX_LENGTH
    padding_side: str = "left"
    special_tokens: tuple = field(default_factory=lambda: tuple(SPECIAL_TOKENS))

    def __post_init__(self):
        if self.padding_side not in ("left", "right"):
            raise ValueError("padding_side must be 'left' or 'right'")
        if self.max_length is not None and self.max_length <= 0:
            raise ValueError("max_length must be > 0")
