"""Fixed values of the task domain."""

# Ranks, labels, word lists and thresholds that results depend on.
PRIORITY_RANK = {"高": 0, "中": 1, "低": 2}
STATUS_RANK = {"进行中": 0, "待执行": 1, "已延期": 2, "已完成": 3}
ACTIVE_STATUS = ("待执行", "进行中")
STATUS_MAP = {"待执行": "open", "进行中": "in_progress", "已完成": "completed", "已延期": "blocked"}
TASK_STATES = ("open", "in_progress", "blocked", "completed", "cancelled")
LABEL_CODES = {"T": "task", "U": "task_update", "D": "decision", "I": "issue", "R": "report", "S": "suggestion", "N": "non_task"}
CANDIDATE_LABELS = ("task", "task_update", "decision", "issue")
ACTION_WORDS = ("完成", "提交", "整改", "检查", "复核", "落实", "解决", "推进", "汇报", "处理", "维修", "检修", "更换", "组织", "安排", "制定", "审核", "排查")
RESPONSIBILITY_WORDS = ("由", "负责", "牵头", "配合", "安监科", "机电队", "责任人")
TIME_WORDS = ("今天", "明天", "本周", "周一", "周二", "周三", "周四", "周五", "月底", "之前", "以内", "前")
STATUS_WORDS = ("已完成", "延期", "取消", "暂停", "受阻", "改为", "改由", "不再执行")
SAFETY_WORDS = ("安全", "隐患", "事故", "应急", "停机", "停产", "瓦斯", "火灾", "爆炸", "高风险")
SENTENCE_MARKS = "。！？；\n"
CHUNK_SIZE, CHUNK_OVERLAP = 2400, 160
GATE_CONFIDENCE = 0.8
# Matcher over all tasks.
A_TITLE, A_DESCRIPTION, A_ASSIGNEE, A_SAME, A_GAP = 0.95, 0.85, 0.08, 0.48, 0.12
# Matcher within a project.
B_WEIGHTS, B_SAME, B_CONTINUITY, B_REVIEW, B_GAP = (0.55, 0.35, 0.10), 0.55, 0.25, 0.42, 0.10
B_DEPARTMENT, B_ASSIGNEE = (0.08, 0.03), (0.10, 0.05)
TOP_K = 5
CONTINUITY_CONFIDENCE = 0.85
EXPORT_MIN_CHARS, EXPORT_NEIGHBOURS, CONTEXT_CHARS = 80, 2, 300
HISTORY_ACTIONS = ("CREATE", "UPDATE_FIELDS", "UPDATE_STATUS", "HUMAN_CREATE")
PATCH_FIELDS = ("title", "description", "work_items", "assignee_raw", "deadline_raw", "status")
COMMAND_ACTIONS = ("CREATE", "UPDATE_FIELDS", "UPDATE_STATUS", "SOFT_DELETE", "NOOP")
