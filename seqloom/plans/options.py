"""Options of an analysis, with their defaults and the rules between them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from seqloom.operators.reduce import UmapOptions

CORRELATIONS = ("kendall", "pearson", "spearman")
TESTS = ("anova", "dids", "snr", "ttest", "wrs")
WITH_PVALUE = ("anova", "ttest", "wrs")


class OptionError(ValueError):
    """Options that do not go together."""


@dataclass
class Options:
    """Everything an analysis can be asked for."""

    k: int = 25
    fmt: str = "fq"
    canonical: bool = True
    ci: int = 1
    cx: int = 4_000_000_000
    cs: int = 65_535
    thr: int = 1
    thr_rat: float = 0.0
    flt: str | None = None
    totals: bool = False
    reuse: bool = False
    outputs: tuple[str, ...] = ()
    normalize: str | None = None
    save_normalized: bool = False
    cor: tuple[str, ...] = ()
    phenotype: str | None = None
    diff: tuple[str, ...] = ()
    classes: str | None = None
    pval_corr: str | None = None
    max_corrected_pval: float = 0.05
    dids_mode: str = "sqrt"
    cv: bool = False
    leave: int = 2
    cv_seed: int = 1_234_567_890
    entropy: bool = False
    n_top: int | None = None
    pca: bool = False
    pca_mode: str = "svd"
    umap: bool = False
    dimensions: int | None = None
    umap_options: UmapOptions = field(default_factory=UmapOptions)
    learn_deseq: bool = False
    learn_q: bool = False
    snr_raw: bool = False
    bins: int = 512

    def __post_init__(self) -> None:
        self.cor, self.diff, self.outputs = (tuple(dict.fromkeys(x)) for x in (self.cor, self.diff, self.outputs))

    @property
    def top(self) -> int:
        return 10_000 if self.n_top is None else self.n_top

    @property
    def dims(self) -> int:
        return 2 if self.dimensions is None else self.dimensions

    def check(self) -> None:
        """Raise :class:`OptionError` for values out of range and combinations that make no sense; warn of odd ones."""
        rules = [
            (1 <= self.k <= 256, "k must lie in 1..256"),
            (self.fmt in ("fq", "fa", "mf"), "unknown input format"),
            (set(self.outputs) <= {"fa", "matrix"}, "unknown output"),
            (self.thr > 0 and self.ci > 0 and self.cx > 0, "thr, ci and cx must be positive"),
            (0 <= self.thr_rat <= 1, "thr_rat must lie in 0..1"),
            (2 <= self.cs <= 4_294_967_295, "cs must lie in 2..4294967295"),
            (self.normalize in (None, "deseq", "freq", "q"), "unknown normalisation"),
            (set(self.cor) <= set(CORRELATIONS), "unknown correlation"),
            (set(self.diff) <= set(TESTS), "unknown differential test"),
            (self.pval_corr in (None, "b", "bh", "by", "hb"), "unknown p-value correction"),
            (0 <= self.max_corrected_pval <= 1, "max_corrected_pval must lie in 0..1"),
            (self.dids_mode in ("sqrt", "quadratic", "tanh"), "unknown mode of dids"),
            (self.pca_mode in ("svd", "covariance"), "unknown mode of pca"),
            (not self.save_normalized or self.normalize, "save_normalized needs normalize"),
            (not self.cor or (self.normalize and self.phenotype), "cor needs normalize and phenotype"),
            (not self.phenotype or self.cor, "phenotype needs cor"),
            (not self.diff or self.classes, "diff needs classes"),
            (not self.classes or self.diff, "classes needs diff"),
            (not set(self.diff) - {"ttest"} or self.normalize, "tests other than ttest need normalize"),
            (not self.pval_corr or set(self.diff) & set(WITH_PVALUE), "pval_corr needs anova, ttest or wrs"),
            (self.dids_mode == "sqrt" or "dids" in self.diff, "dids_mode needs dids"),
            (not self.cv or self.cor, "cv needs cor"),
            (self.n_top is None or self.n_top >= 1, "n_top must be at least 1"),
            (self.n_top is None or self.cor or self.entropy or {"snr", "dids"} & set(self.diff), "n_top needs cor, entropy, snr or dids"),
            (not (self.pca or self.umap) or self.normalize, "pca and umap need normalize"),
            (self.dimensions is None or self.pca or self.umap, "dimensions needs pca or umap"),
            (not (self.learn_deseq or self.learn_q) or self.reuse, "learn_deseq and learn_q need reuse"),
            (self.bins > 0, "bins must be positive"),
        ]
        for ok, text in rules:
            if not ok:
                raise OptionError(text)
        if self.thr > 1 and self.thr_rat == 0:
            warnings.warn("thr has no effect while thr_rat is 0", stacklevel=2)
        if "wrs" in self.diff:
            warnings.warn("wrs always uses the normal approximation, which is rough for few samples", stacklevel=2)

    def check_samples(self, samples: int, classes: list[int] | None) -> None:
        """The rules that depend on the number of samples and classes."""
        if (self.pca or self.umap) and not 1 <= self.dims < samples:
            raise OptionError(f"dimensions must be at least 1 and below the {samples} samples")
        if self.cv and (not 1 <= self.leave < samples or samples % self.leave):
            raise OptionError(f"leave must be at least 1, below {samples}, and divide it")
        if classes is not None and {"ttest", "snr", "wrs"} & set(self.diff) and max(classes) + 1 != 2:
            raise OptionError("ttest, snr and wrs need two classes")

    def matrix_settings(self, names: list[str]) -> dict:
        """What a kept matrix must have been made with to be used again."""
        return {
            "k": self.k, "canonical": self.canonical, "ci": self.ci, "cx": self.cx, "cs": self.cs,
            "thr": self.thr, "thr_rat": self.thr_rat, "flt": self.flt, "samples": names,
        }
