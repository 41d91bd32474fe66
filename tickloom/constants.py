"""Rates, thresholds and word lists that results depend on."""

# --- fixed values: exchange session (local time, seconds of day) ---
SESSION_OPEN = 9 * 3600 + 15 * 60
SESSION_CLOSE = 15 * 3600 + 30 * 60
ENTRY_FROM = 9 * 3600 + 30 * 60
MODEL_ENTRY_FROM = 10 * 3600 + 20 * 60
HARD_EXIT_FROM = 15 * 3600 + 5 * 60
FIRST_PERIOD_END = "10:15"
EXCHANGE_ZONE = "Asia/Kolkata"

# --- fixed values: charge schedule, (buy, sell) where two numbers ---
TRANSACTION_TAX = {"delivery": (0.001, 0.001), "intraday": (0.0, 0.00025), "option": (0.0, 0.0015)}
STAMP_ON_BUY = {"delivery": 0.00015, "intraday": 0.00003, "option": 0.00003}
EXCHANGE_FEE = {"delivery": 0.0000307, "intraday": 0.0000307, "option": 0.0003553}
REGULATOR_FEE = 10 / 1e7
GST = 0.18
OPTION_BROKERAGE = 20.0
ZERODHA_RATE, ZERODHA_MAX, ZERODHA_DEPOSITORY = 0.0003, 20.0, 15.34
GROWW_RATE, GROWW_MIN, GROWW_MAX, GROWW_DEPOSITORY = 0.001, 5.0, 20.0, 16.5 + 3.5
GROWW_DEPOSITORY_FROM = 100.0

# --- fixed values: fills, tickets and exits ---
STOCK_SLIPPAGE_BPS = 15.0
ETF_SLIPPAGE_BPS = 5.0
OPTION_SLIPPAGE_BPS = 50.0
PRICE_STEP = 0.05
START_CASH = 200_000.0
MIN_TICKET = 5_000.0
TAKE_PROFIT = 0.02
STOP_LOSS = -0.015
DISASTER_STOP = -0.25
MIN_HOLD_SESSIONS = 63
BAND_TOUCH = 0.001
PRICE_GAP = 0.25
NOT_QUOTED = ("option", "entitlement")

# --- fixed values: ranking edge ---
TOP_EXCESS = 0.0110
EDGE_HORIZON = 21
EDGE_MARGIN = 0.25
INTRADAY_ROUND_TRIP = 0.0036
EDGE_MULTIPLE = 2.0
NAME_CORRELATION = 0.35
MAX_BOOK = 12

# --- fixed values: sizing ---
CONFIDENCE_CAP, CONFIDENCE_FLOOR = 0.35, 0.05
EDGE_SHARE_CAP = 0.30
STAKE_LO, STAKE_HI, STAKE_MAX_WEIGHT = 0.5, 1.6, 0.30
WILD_STAKE_HI, WILD_MAX_WEIGHT = 3.0, 1.0
STAKE_POWER = 2.0

# --- fixed values: names held per rule ---
TOP_N = 5
CONFIDENCE_NAMES, KEEP_RANK = 8, 0.75
MODEL_NAMES, WILD_NAMES = 6, 3
STALE_DAYS = 4
EXIT_MIN_AGE, EXIT_MARGIN = 10, 0.02

# --- fixed values: cross-section reversion ---
REVERSION_ENTRY_Z, REVERSION_EXIT_Z = 1.5, 0.25
REVERSION_EXIT_GAP, REVERSION_MIN_SD = 0.003, 0.003
REVERSION_MIN_NAMES, REVERSION_MAX_NAMES, REVERSION_TICKET = 12, 8, 0.12

# --- fixed values: same-day trades ---
INTRADAY_CHARGES = 0.0006
DEFAULT_SLIPPAGE = 0.0015
SUCCESS_NET = 0.002
MIN_TURNOVER, MIN_PRICE = 5e7, 20
MAX_MOVE = 0.20
SLIPPAGE_TIERS = ((5e8, 0.0010), (2e8, 0.0020), (0.0, 0.0035))
ROUND_TRIP = 0.0006 + 2 * 0.0015

# --- fixed values: options ---
RATE, VOL_PREMIUM, STRIKE_STEP, OPTION_LOT = 0.065, 1.15, 50, 75
DEFAULT_VOL = 0.2

# --- fixed values: books and alerts ---
ALLOCATOR_LOOKBACK, SWITCH_COST, ALLOCATOR_MIN_ROWS = 20, 0.002, 5
BIG_MOVE = 0.02
GOAL_PCT, GOAL_BY = 10.0, "2026-10-31"

# --- fixed values: names that are not companies ---
FUND_WORDS = ("ETF", "BEES", "LIQUID", "LIQID", "BETA", "NEXT50", "NIFTY", "SENSEX", "GOLD", "SILVER",
              "GILT", "GSEC", "IETF")
SNAPSHOT_FUND_WORDS = ("ETF", "BEES", "LIQUID", "GILT", "GSEC", "NIFTY", "SENSEX")
SMALL_PLATFORM_SUFFIXES = ("-SM.NS", "-ST.NS")
ALWAYS_QUOTED = ("NIFTYBEES.NS", "GOLDBEES.NS", "HDFCSML250.NS", "^NSEI")

# --- fixed values: feature columns fed to the learners ---
DAY_FEATURES = ("gap", "first_hr_ret", "first_hr_vol_ratio", "prev_ret", "prev_intraday", "prev_range",
                "ret_5d", "ret_20d", "vol_20d", "dist_20d_high", "mkt_gap", "mkt_first_hr", "rel_first_hr",
                "first_hr_range")
ENTRY_FEATURES = ("ret_so_far", "gap", "last_bar_ret", "range_so_far", "pos_in_range", "vol_ratio_so_far",
                  "prev_ret", "prev_intraday", "ret_5d", "vol_20d", "mkt_so_far", "mkt_last_bar",
                  "rel_so_far", "entry_bar", "hold_bars")
