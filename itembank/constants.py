"""Question types, answer words, review intervals, limits."""

# --- fixed values: question types in display order -------------------------------------------
SINGLE, MULTI, JUDGE, SHORT, ESSAY = "单选", "多选", "判断", "简答", "论述"
QUESTION_TYPES = [SINGLE, MULTI, JUDGE, SHORT, ESSAY]
SUBJECTIVE_TYPES = [SHORT, ESSAY]
TRUE_WORD, FALSE_WORD = "正确", "错误"
OPTION_LETTERS = "ABCDEFGHIJ"

# --- fixed values: words read as true or false ------------------------------------------------
TRUE_WORDS = ["正确", "对", "是", "T", "TRUE", "Y", "YES", "√", "✓", "V", "1", "对的", "正确的"]
FALSE_WORDS = ["错误", "错", "否", "不对", "不是", "F", "FALSE", "N", "NO", "×", "X", "✗", "0", "错的", "错误的"]

# --- fixed values: review schedule ------------------------------------------------------------
INTERVALS = [0, 1, 2, 4, 7, 15, 30]
GRADUATE_STREAK = 7

# --- fixed values: practice modes -------------------------------------------------------------
MODES = {
    "order": "顺序练习",
    "random": "随机练习",
    "wrong": "错题重练",
    "favorite": "收藏题目练习",
    "due": "今日艾宾浩斯复习",
    "typeOrder": "题型专项·顺序练习",
    "typeRandom": "题型专项·随机练习",
    "typeYear": "题型专项·按时间顺序练习",
}

# --- fixed values: limits of reports ----------------------------------------------------------
WEAK_TOP = 5
WEAK_MERGE_TOP = 50
RECENT_KEPT = 20
RECENT_SHOWN = 10
WARNINGS_KEPT = 20
LOG_ROWS_SHOWN = 20
DEBUG_LINES = 300
LOW_ACCURACY = 60
