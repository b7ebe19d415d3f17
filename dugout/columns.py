"""Column names of the pitch log and of the tables derived from it.

Everything in this module is a fixed value: the names are those of the public pitch export and of
the stage tables built from it, so results line up with data produced elsewhere.
"""

from __future__ import annotations

# --- fixed values: raw pitch log, by type -----------------------------------------------------
RAW_TYPES: dict[str, list[str]] = {
    "date": ["game_date"],
    "bigint": """game_pk pitcher batter on_1b on_2b on_3b fielder_2 fielder_3 fielder_4 fielder_5
        fielder_6 fielder_7 fielder_8 fielder_9""".split(),
    "int": """at_bat_number pitch_number inning balls strikes outs_when_up game_year
        n_thruorder_pitcher n_priorpa_thisgame_player_at_bat bat_score fld_score home_score
        away_score post_home_score home_score_diff age_pit age_bat age_pit_legacy age_bat_legacy
        pitcher_days_since_prev_game pitcher_days_until_next_game batter_days_since_prev_game
        batter_days_until_next_game zone hit_location launch_speed_angle""".split(),
    "string": """pitch_type pitch_name player_name description type events bb_type des game_type
        stand p_throws home_team away_team inning_topbot if_fielding_alignment
        of_fielding_alignment sv_id tfs_deprecated tfs_zulu_deprecated""".split(),
    "double": """release_speed release_pos_x release_pos_y release_pos_z pfx_x pfx_z plate_x
        plate_z vx0 vy0 vz0 ax ay az effective_speed release_spin_rate release_extension spin_axis
        spin_dir spin_rate_deprecated break_angle_deprecated break_length_deprecated
        delta_home_win_exp delta_run_exp delta_pitcher_run_exp home_win_exp bat_win_exp bat_speed
        swing_length miss_distance estimated_slg_using_speedangle estimated_ba_using_speedangle
        estimated_woba_using_speedangle woba_value woba_denom babip_value iso_value hyper_speed
        api_break_z_with_gravity api_break_x_arm api_break_x_batter_in arm_angle attack_angle
        attack_direction swing_path_tilt intercept_ball_minus_batter_pos_x_inches
        intercept_ball_minus_batter_pos_y_inches hit_distance_sc launch_speed launch_angle sz_top
        sz_bot""".split(),
}

# --- fixed values: columns replaced by the value on the previous pitch of the game ------------
PITCH_RESULTS: list[str] = """release_speed release_pos_x release_pos_z description zone type pfx_x
    pfx_z plate_x plate_z vx0 vy0 vz0 ax ay az effective_speed release_spin_rate release_extension
    release_pos_y spin_axis delta_home_win_exp delta_run_exp bat_speed swing_length miss_distance
    estimated_slg_using_speedangle delta_pitcher_run_exp hyper_speed api_break_z_with_gravity
    api_break_x_arm api_break_x_batter_in arm_angle attack_angle attack_direction swing_path_tilt
    intercept_ball_minus_batter_pos_x_inches intercept_ball_minus_batter_pos_y_inches
    hit_distance_sc launch_speed launch_angle""".split()

# --- fixed values: columns replaced by the result of the previous plate appearance ------------
PA_RESULTS: list[str] = """events hit_location bb_type estimated_ba_using_speedangle
    estimated_woba_using_speedangle woba_value woba_denom babip_value iso_value
    launch_speed_angle""".split()

# --- fixed values: columns dropped on the way to KG2 and to KG3 -------------------------------
KG2_DROPPED: list[str] = """vx0_of_prev_pitch vy0_of_prev_pitch vz0_of_prev_pitch
    ax_of_prev_pitch ay_of_prev_pitch az_of_prev_pitch plate_z_of_prev_pitch plate_x_of_prev_pitch
    pfx_z_of_prev_pitch pfx_x_of_prev_pitch api_break_z_with_gravity_of_prev_pitch
    api_break_x_arm_of_prev_pitch api_break_x_batter_in_of_prev_pitch attack_angle_of_prev_pitch
    hyper_speed_of_prev_pitch attack_direction_of_prev_pitch swing_length_of_prev_pitch
    intercept_ball_minus_batter_pos_x_inches_of_prev_pitch
    intercept_ball_minus_batter_pos_y_inches_of_prev_pitch swing_path_tilt_of_prev_pitch
    arm_angle_of_prev_pitch release_spin_rate_of_prev_pitch spin_axis_of_prev_pitch
    release_extension_of_prev_pitch release_pos_x_of_prev_pitch release_pos_y_of_prev_pitch
    release_pos_z_of_prev_pitch sv_id game_year tfs_deprecated tfs_zulu_deprecated spin_dir
    spin_rate_deprecated break_angle_deprecated break_length_deprecated des""".split()

KG2_ADDED: list[str] = """pitch_type_of_prev_pitch p/h_hand count count_state pitch_number_of_game
    prior_pa_vs_pitcher_career pitcher_team_score_diff strike_zone_height""".split()

KG3_DROPPED: list[str] = """effective_speed_of_prev_pitch delta_home_win_exp_of_prev_pitch
    home_win_exp age_bat_legacy post_home_score fielder_2 fielder_3 fielder_4 fielder_5 fielder_6
    fielder_7 fielder_8 fielder_9 home_score away_score home_score_diff age_pit_legacy
    pitcher_days_until_next_game batter_days_until_next_game player_name
    batter_days_since_prev_game p/h_hand""".split()

# --- fixed values: pitch codes with a rolling usage rate; anything else counts as OTHER -------
PITCH_CODES: list[str] = "CH CS CU EP FA FC FF FO FS IN KC KN PO SC SI SL ST SV".split()
RATE_BUCKETS: list[str] = [*PITCH_CODES, "OTHER"]
RATE_COLUMNS: list[str] = [f"prev3_pitch_rate_{code}" for code in RATE_BUCKETS]

# --- fixed values: model input ----------------------------------------------------------------
KG4_BASE: list[str] = """game_date pitch_number_of_ab at_bat_number_of_game events_of_prev_ab
    hit_location_of_prev_ab bb_type_of_prev_ab launch_speed_angle_of_prev_ab inning
    n_thruorder_pitcher pitch_type batter pitcher game_type stand p_throws home_team away_team
    balls strikes on_3b on_2b on_1b outs_when_up inning_topbot sz_top sz_bot game_pk bat_score
    fld_score if_fielding_alignment of_fielding_alignment bat_win_exp age_pit age_bat
    n_priorpa_thisgame_player_at_bat pitcher_days_since_prev_game release_speed_of_prev_pitch
    description_of_prev_pitch zone_of_prev_pitch type_of_prev_pitch hit_distance_sc_of_prev_pitch
    launch_speed_of_prev_pitch launch_angle_of_prev_pitch pitch_type_of_prev_pitch count
    count_state pitch_number_of_game prior_pa_vs_pitcher_career pitcher_team_score_diff
    strike_zone_height""".split()
KG4: list[str] = [*KG4_BASE, *RATE_COLUMNS]

# --- fixed values: display names and families of the pitch codes ------------------------------
PITCH_NAMES: dict[str, str] = {
    "CH": "changeup", "CS": "slow curve", "CU": "curveball", "FC": "cutter", "FF": "four-seam",
    "FO": "forkball", "FS": "splitter", "KC": "knuckle curve", "KN": "knuckleball",
    "SC": "screwball", "SI": "sinker", "SL": "slider", "ST": "sweeper", "SV": "slurve",
}
PITCH_FAMILIES: dict[str, str] = {
    "FF": "Fastball", "SI": "Fastball", "FC": "Fastball",
    "SL": "Breaking Ball", "ST": "Breaking Ball", "CU": "Breaking Ball", "KC": "Breaking Ball",
    "SV": "Breaking Ball", "CS": "Breaking Ball", "SC": "Breaking Ball",
    "CH": "Offspeed", "FS": "Offspeed", "FO": "Offspeed", "KN": "Offspeed",
}

# --- fixed values: evaluation history ---------------------------------------------------------
HISTORY_TYPES: dict[str, str] = {
    "game_date": "string", "season": "bigint", "game_pk": "bigint", "pitcher_id": "bigint",
    "pitcher_name": "string", "opponent": "string", "pitch_count": "bigint",
    "model_correct": "bigint", "baseline_correct": "bigint", "model_accuracy": "double",
    "baseline_accuracy": "double", "accuracy_over_baseline": "double",
    "accuracy_over_baseline_pp": "double", "relative_improvement": "double",
    "relative_improvement_percent": "double", "baseline_strategy": "string",
    "model_version": "string", "feature_version": "string", "evaluation_version": "string",
    "model_path": "string", "predictions_path": "string", "summary_path": "string",
    "evaluated_at_utc": "string",
    # written by the walk-forward backtest; kept in the same table so neither writer erases them
    "training_cutoff": "string", "backtest_version": "string",
}
MODEL_VERSION = "rf_v1"
FEATURE_VERSION = "kg4_v1"
EVALUATION_VERSION = "postgame_v1"
BACKTEST_VERSION = "walkforward_rf_stratified_v1"
FIRST_TRACKED_DATE = "2008-03-25"

LOG_KEY = ["pitcher", "game_pk", "at_bat_number", "pitch_number"]
LOG_ORDER = ["game_date", "game_pk", "at_bat_number", "pitch_number"]
NOT_FEATURES = ["pitch_type", "game_pk", "game_date", "pitcher", "season"]


def prev_pitch(name: str) -> str:
    return f"{name}_of_prev_pitch"


def prev_pa(name: str) -> str:
    return f"{name}_of_prev_ab"


def raw_ddl() -> str:
    """Declared schema of the raw log (CSV type inference would differ from file to file)."""
    return ", ".join(f"`{c}` {t}" for t, names in RAW_TYPES.items() for c in names)
