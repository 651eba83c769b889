"""Run parameters. The defaults are fixed values that results depend on."""

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RecoParams:
    # fixed values
    n_popular: int = 15000  # articles in the popularity list
    block: int = 300  # articles handed to a customer row at a time
    keep: int = 200  # scored rows kept per customer
    top_k: int = 12  # rows published per customer
    short_days: int = 30
    mid_days: int = 90
    hist_days: int = 366
    recent_days: int = 7
    n_weeks: int = 10  # reference days replayed for training
    label_days: int = 7
    popular_lead_days: int = 28  # popularity days before the label week
    label_decay: float = 0.05  # label weight lost per week of age
    n_negatives: int = 50
    rare_limit: int = 10  # codes seen this often or less share one code
    smoothing: int = 5  # added to the buyers of a repeat rate
    stack_top: int = 24  # rows per model and customer used for stacking
    share_top: int = 30  # rows per customer handed to the next stage
    n_folds: int = 10
    seed: int = 46

    @property
    def stale_days(self) -> int:
        """Recency given to a key with no purchase in the history."""
        return self.hist_days + 10

    @property
    def popular_days(self) -> int:
        return self.popular_lead_days + self.label_days

    def scaled(self, **changes) -> "RecoParams":
        return replace(self, **changes)
