"""Names of the features: key-sets, windows and fill rules."""

from dataclasses import dataclass

from shelfrank.operators.fill import FillPolicy
from shelfrank.params import RecoParams


@dataclass(frozen=True)
class AttributeKey:
    """Purchases of a customer among articles that share attributes. The empty suffix is the
    article itself."""

    suffix: str
    columns: tuple[str, ...]
    all_windows: bool = False

    @property
    def tail(self) -> str:
        return f"_{self.suffix}" if self.suffix else ""

    @property
    def counts(self) -> dict[str, str]:
        """Feature name -> merged measure."""
        names = {f"n_buy_hist{self.tail}": "n_hist", f"n_buy_recent{self.tail}": "n_recent"}
        if self.all_windows:
            names[f"n_buy_hist_short{self.tail}"] = "n_short"
            names[f"n_buy_hist_mid{self.tail}"] = "n_mid"
        return names

    @property
    def recency(self) -> str:
        return f"days_after_buy{self.tail}"


PAIR = AttributeKey("", ("article_id",), True)

# fixed values: attribute key-sets and their short names
ATTRIBUTE_KEYS = (
    AttributeKey("prod", ("product_code",)),
    AttributeKey("ptype", ("product_type_no",)),
    AttributeKey("graph", ("graphical_appearance_no",)),
    AttributeKey("col", ("colour_group_code",)),
    AttributeKey("dep", ("department_no",), True),
    AttributeKey("idx", ("index_code",)),
    AttributeKey("idxg", ("index_group_no",)),
    AttributeKey("sec", ("section_no",), True),
    AttributeKey("garm", ("garment_group_no",)),
    AttributeKey("code_pcol", ("index_code", "colour_group_code")),
    AttributeKey("idxg_sec", ("index_group_no", "section_no")),
    AttributeKey("idxg_gram", ("index_group_no", "garment_group_no")),
)

# fixed values: features whose recent share of history is derived
TREND_SUFFIXES = ("ptype", "graph", "col", "dep", "idx", "idxg", "sec", "garm")

WINDOW_TAILS = {"hist": "n_hist", "hist_short": "n_short", "hist_mid": "n_mid", "recent": "n_recent"}
ARTICLE_COUNTS = {
    **{f"art_buy_{tail}": measure for tail, measure in WINDOW_TAILS.items()},
    "art_buy_yesterday": "n_yesterday",
    "art_buy_hist_ch1": "n_ch1",
    "art_buy_hist_ch2": "n_ch2",
}
CODE_COUNTS = {
    "code_buy_hist": "n_hist",
    "code_buy_recent": "n_recent",
    "code_buy_yesterday": "n_yesterday",
}
CUSTOMER_COUNTS = {f"n_buy_{tail}_all": measure for tail, measure in WINDOW_TAILS.items()}
AGE_ARTICLE_COUNTS = {"age_id_n_buy_hist": "n_hist", "age_id_n_buy_recent": "n_recent"}
REPEAT_RATES = ("rebuy_rate", "code_rebuy_rate", "cust_rebuy_rate")
CHANNEL_RATES = (
    "rate_sales_channel_hist", "rate_sales_channel_recent",
    "art_rate_sales_channel_hist", "art_rate_sales_channel_recent",
)
STATISTICS = ("mean", "median", "max", "min")


def _keys() -> tuple[AttributeKey, ...]:
    return (PAIR, *ATTRIBUTE_KEYS)


def zero_filled() -> list[str]:
    names = [n for key in _keys() for n in key.counts]
    for group in (ARTICLE_COUNTS, CODE_COUNTS, CUSTOMER_COUNTS, AGE_ARTICLE_COUNTS):
        names.extend(group)
    return [*names, *REPEAT_RATES]


def stale_filled() -> list[str]:
    return [key.recency for key in _keys()] + [
        "days_after_buy_all", "days_from_oldest_buy_all",
        "art_days_after_buy", "art_days_from_oldest_buy", "art_days_from_mode_buy",
    ]


def candidate_policy(params: RecoParams) -> FillPolicy:
    """Counts and rates 0, recencies older than the history, channel between the two."""
    return FillPolicy(
        {
            **dict.fromkeys(zero_filled(), 0),
            **dict.fromkeys(stale_filled(), params.stale_days),
            **dict.fromkeys(CHANNEL_RATES, 1.5),
        }
    )


def stack_policy(params: RecoParams) -> FillPolicy:
    """As above, and rank 100000 for rows a model did not rank."""
    base = candidate_policy(params).by_name
    return FillPolicy({**base, "art_buy_hist_decay": 0}, {"_rank": 100000})
