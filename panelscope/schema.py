"""Column orders, default parameters and dimension tables of the price panel."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

#: Rows back, and the prefix of the column names (fixed values).
HORIZONS = ((1, "1d"), (20, "20d"), (252, "252d"))
VOL_WINDOWS = ((20, "20d"), (60, "60d"), (252, "252d"))
TRADING_DAYS = 252

#: Columns of a written panel, in order (fixed values).
FEATURE_COLUMNS = (
    "date", "ticker", "price",
    "1d_log_ret", "20d_log_ret", "252d_log_ret",
    "1d_arith_ret", "20d_arith_ret", "252d_arith_ret",
    "20d_vol", "60d_vol", "252d_vol",
    "exchange", "country", "region",
)

#: Exchange suffix, country (fixed values).
EXCHANGE_COUNTRY = (
    ("LN", "United Kingdom"), ("FP", "France"), ("GY", "Germany"), ("NA", "Netherlands"), ("IM", "Italy"), ("SQ", "Spain"),
    ("SE", "Switzerland"), ("SS", "Sweden"), ("DC", "Denmark"), ("FH", "Finland"), ("NO", "Norway"), ("BB", "Belgium"),
    ("AV", "Austria"), ("PL", "Portugal"), ("ID", "Ireland"), ("PW", "Poland"),
)
#: Country, region (fixed values).
COUNTRY_REGION = (
    ("United Kingdom", "UK & Ireland"), ("Ireland", "UK & Ireland"), ("France", "Western Europe"), ("Germany", "Western Europe"),
    ("Netherlands", "Western Europe"), ("Belgium", "Western Europe"), ("Austria", "Western Europe"), ("Switzerland", "Western Europe"),
    ("Italy", "Southern Europe"), ("Spain", "Southern Europe"), ("Portugal", "Southern Europe"), ("Sweden", "Nordic"),
    ("Denmark", "Nordic"), ("Finland", "Nordic"), ("Norway", "Nordic"), ("Poland", "Eastern Europe"),
)


@dataclass(frozen=True)
class Config:
    """Parameters that a configuration file can carry; what it leaves out has these defaults (fixed values)."""

    return_horizons: tuple = HORIZONS
    vol_windows: tuple = VOL_WINDOWS
    lbw: int = 21
    macd_pairs: tuple = ((8, 24), (16, 28), (32, 96))
    vol_target: float = 0.15
    ewm_span: int = 60
    assets: tuple = ()

    @staticmethod
    def read(path: str) -> Config:
        """A YAML file (or JSON, which is YAML too); keys that aren't parameters here are for others. YAML needs PyYAML."""
        with open(path) as f:
            text = f.read()
        try:
            found = json.loads(text)
        except ValueError:
            import yaml

            found = yaml.safe_load(text)
        known = {x.name for x in fields(Config)}
        plain = lambda v: tuple(map(plain, v)) if isinstance(v, list) else v
        return Config(**{k: plain(v) for k, v in (found or {}).items() if k in known})
