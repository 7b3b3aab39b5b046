"""Fixed schemas of the pitch table and its lookups."""

from __future__ import annotations

from pyspark.sql import types as T

PITCH_KEY = ["game_date", "game_pk", "at_bat_number", "pitch_number"]
PITCH_ORDER = ["game_date", "game_pk", "inning", "at_bat_number", "pitch_number"]

# The columns of the pitch table in the order of the feed, and those that are not whole numbers.
PITCH_COLUMNS = """
    pitch_type game_date release_speed release_pos_x release_pos_z player_name batter pitcher events description
    spin_dir spin_rate_deprecated break_angle_deprecated break_length_deprecated zone des game_type stand p_throws
    home_team away_team type hit_location bb_type balls strikes game_year pfx_x pfx_z plate_x plate_z on_3b on_2b
    on_1b outs_when_up inning inning_topbot hc_x hc_y tfs_deprecated tfs_zulu_deprecated fielder_2 umpire sv_id vx0
    vy0 vz0 ax ay az sz_top sz_bot hit_distance_sc launch_speed launch_angle effective_speed release_spin_rate
    release_extension game_pk fielder_3 fielder_4 fielder_5 fielder_6 fielder_7 fielder_8 fielder_9 release_pos_y
    estimated_ba_using_speedangle estimated_woba_using_speedangle woba_value woba_denom babip_value iso_value
    launch_speed_angle at_bat_number pitch_number pitch_name home_score away_score bat_score fld_score
    post_away_score post_home_score post_bat_score post_fld_score if_fielding_alignment of_fielding_alignment
    spin_axis delta_home_win_exp delta_run_exp bat_speed swing_length""".split()
TEXT_COLUMNS = """pitch_type player_name events description des game_type stand p_throws home_team away_team
    type bb_type inning_topbot pitch_name if_fielding_alignment of_fielding_alignment""".split()
FLOAT_COLUMNS = """release_speed release_pos_x release_pos_z pfx_x pfx_z plate_x plate_z hc_x hc_y vx0 vy0 vz0 ax ay
    az sz_top sz_bot launch_speed effective_speed release_extension release_pos_y estimated_ba_using_speedangle
    estimated_woba_using_speedangle woba_value delta_home_win_exp delta_run_exp""".split()
# Columns some feeds repeat under a second name.
REPEATED_COLUMNS = ["pitcher.1", "fielder_2.1"]

_TYPES = (
    dict.fromkeys(TEXT_COLUMNS, T.StringType()) | dict.fromkeys(FLOAT_COLUMNS, T.FloatType()) | {"game_date": T.TimestampType()}
)
PITCH_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.LongType()), c not in PITCH_KEY) for c in PITCH_COLUMNS])

SPEED_SCHEMA = "runner_id long, r_sprint_speed_top50percent double"
FIELDING_SCHEMA = (
    "year string, entity_id int, entity_name string, outs_above_average_rhh double, outs_above_average_lhh double"
)
PARK_SCHEMA = "venue_id long, venue_name string"
VENUE_SCHEMA = "dates array<struct<games:array<struct<venue:struct<id:long,name:string>>>>>"
OFFER_SCHEMA = """eventGroup struct<
    events: array<struct<providerEventId:string, teamName1:string, teamName2:string, startDate:string,
        eventGroupName:string, eventStatus:struct<state:string>>>,
    offerCategories: array<struct<offerSubcategoryDescriptors: array<struct<offerSubcategory: struct<
        offers: array<array<struct<providerEventId:string, label:string,
            outcomes:array<struct<label:string, line:double, oddsDecimal:double>>>>>>>>>>>"""
PARAMETER_SCHEMA = """classifier__max_depth int, classifier__min_child_weight int, classifier__subsample double,
    classifier__colsample_bytree double, classifier__learning_rate double, classifier__n_estimators int,
    classifier__eval_metric string"""
