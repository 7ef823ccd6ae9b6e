"""Specifications of datasets, mixes and encodings; checked when they are built."""

from __future__ import annotations

from dataclasses import dataclass, field

IGNORE = -100
ROLES = ("user", "assistant", "system", "function", "observation")
STAGES = ("pt", "sft", "rm", "kto", "unsupervised")


@dataclass(frozen=True)
class DatasetSpec:
    """Where rows come from and which source column or tag plays which part; names as in a catalogue entry."""

    name: str
    source: str = "file"  #: file, script or hub
    location: str = ""
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    formatting: str = "alpaca"
    ranking: bool = False
    columns: dict = field(default_factory=lambda: {"prompt": "instruction", "query": "input", "response": "output"})
    tags: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.formatting not in ("alpaca", "sharegpt"):
            raise ValueError(f"unknown formatting {self.formatting}")

    def column(self, part: str) -> str | None:
        return self.columns.get(part)

    def tag(self, part: str) -> str:
        return {**DEFAULT_TAGS, **self.tags}[part]


#: Message tags of the second format.
DEFAULT_TAGS = {
    "role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt",
    "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system",
}


@dataclass(frozen=True)
class DataArgs:
    """How datasets are mixed, cut and split."""

    cutoff_len: int = 2048
    train_on_prompt: bool = False
    mask_history: bool = False
    streaming: bool = False
    mix_strategy: str = "concat"
    interleave_probs: tuple[float, ...] | None = None
    max_samples: int | None = None
    val_size: float = 0.0
    packing: bool | None = None  #: None: pre-training packs, other stages do not
    neat_packing: bool = False
    datasets: tuple[str, ...] = ()
    eval_datasets: tuple[str, ...] = ()
    max_steps: int = -1
    batch_size: int = 1000
    media_dir: str | None = None  #: where media lie; the catalogue's folder if not told

    def __post_init__(self):
        if self.mix_strategy not in ("concat", "interleave_under", "interleave_over"):
            raise ValueError(f"unknown mix strategy {self.mix_strategy}")
        if self.val_size > 1e-6 and not self.datasets:
            raise ValueError("a validation share needs a dataset")
        if self.eval_datasets and self.val_size > 1e-6:
            raise ValueError("give evaluation datasets or a validation share, not both")
        if self.interleave_probs is not None:
            if self.mix_strategy == "concat":
                raise ValueError("probabilities are for interleaving only")
            if len(self.interleave_probs) != len(self.datasets):
                raise ValueError("one probability per dataset")
        if self.streaming and 1e-6 < self.val_size < 1:
            raise ValueError("a stream needs a whole number of validation rows")
        if self.streaming and self.max_samples is not None:
            raise ValueError("a stream takes no max_samples")
        if self.streaming and self.max_steps < 1:
            raise ValueError("a stream needs max_steps")
        if self.mask_history and self.train_on_prompt:
            raise ValueError("mask_history and train_on_prompt exclude each other")
        if self.neat_packing and not self.packing:
            object.__setattr__(self, "packing", True)

    @property
    def capacity(self) -> int:
        """Tokens of a packed row before its padding token."""
        return self.cutoff_len - 1 if self.packing else self.cutoff_len


@dataclass(frozen=True)
class RunSpec:
    """What a run does with its data: stage, layout, tokenizer, seed; whether it generates, predicts or evaluates; where encoded rows are kept."""

    stage: str = "sft"
    template: str = "default"
    tokenizer: str = "whitespace"
    eos: str = "</s>"
    add_bos: bool = False
    seed: int = 42
    train: bool = True
    evaluate: bool = False
    predict: bool = False
    generate: bool = False
    tokenized: str | None = None

    def __post_init__(self):
        if self.stage not in ("pt", "sft", "rm", "ppo", "kto"):
            raise ValueError(f"unknown stage {self.stage}")


def check_run(run: RunSpec, args: DataArgs) -> None:
    """What a stage and its data arguments exclude."""
    if run.stage != "sft":
        if run.generate:
            raise ValueError("only the sft stage generates predictions")
        if args.neat_packing:
            raise ValueError("only the sft stage packs neatly")
        if args.train_on_prompt or args.mask_history:
            raise ValueError("train_on_prompt and mask_history are for the sft stage")
    elif run.predict and not run.generate:
        raise ValueError("predictions need generate")
    if run.stage == "ppo" and not run.train:
        raise ValueError("the ppo stage trains only")
    if run.train and not args.datasets:
        raise ValueError("name a dataset to train on")
    if (run.evaluate or run.predict) and not args.eval_datasets and args.val_size < 1e-6:
        raise ValueError("name a dataset to evaluate on, or a validation share")
    if run.generate and not args.eval_datasets:
        raise ValueError("generate needs a dataset to evaluate on")


def check_stage(stage: str, ranking: bool) -> None:
    """Reward models need ranked data, and no other stage takes it."""
    if stage == "rm" and not ranking:
        raise ValueError("this stage needs a ranking dataset")
    if stage != "rm" and ranking:
        raise ValueError("this stage takes no ranking dataset")
