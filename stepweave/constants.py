"""Fixed values that outputs must agree on: task names, suites, prompt texts, robot constants."""

# Evaluation tasks, in report order.
TASKS = [
    "BinFill", "PickXtimes", "SwingXtimes", "StopCube",
    "VideoUnmask", "ButtonUnmask", "VideoUnmaskSwap", "ButtonUnmaskSwap",
    "PickHighlight", "VideoRepick", "VideoPlaceButton", "VideoPlaceOrder",
    "MoveCube", "InsertPeg", "PatternLock", "RouteStick",
]

# Task suites, four tasks each.
SUITES = {
    "Counting": ["BinFill", "PickXtimes", "SwingXtimes", "StopCube"],
    "Persistent": ["ButtonUnmask", "VideoUnmask", "VideoUnmaskSwap", "ButtonUnmaskSwap"],
    "Referential": ["PickHighlight", "VideoRepick", "VideoPlaceButton", "VideoPlaceOrder"],
    "Behavior": ["MoveCube", "InsertPeg", "PatternLock", "RouteStick"],
}

# Tasks that start with a recorded demonstration.
DEMO_TASKS = [
    "VideoUnmask", "VideoUnmaskSwap", "VideoPlaceButton", "VideoPlaceOrder", "VideoRepick",
    "MoveCube", "InsertPeg", "PatternLock", "RouteStick",
]

# Tasks whose first action is long: no query before count 75.
LONG_FIRST_ACTION_TASKS = [
    "BinFill", "PickXtimes", "SwingXtimes", "ButtonUnmask", "ButtonUnmaskSwap", "PickHighlight",
    "VideoRepick", "VideoPlaceButton", "VideoPlaceOrder", "MoveCube", "InsertPeg",
]

# Kinds of symbolic runs whose logs lie one folder deeper.
SYMBOLIC_TYPES = ["oracle", "gemini", "qwenvl", "memer"]

# Prompt texts of the chat records and queries.
SIMPLE_SYSTEM = ("You are a helpful assistant to help guide the robot to complete the task "
                 "by predicting a sequence of language subgoals")
GROUNDED_SYSTEM = ("You are a helpful assistant to help guide the robot to complete the task "
                   "by predicting a sequence of grounded language subgoals")
KEYFRAME_SYSTEM = (
    "You are a robot program that predicts actions. The current input images from the front-view camera shows "
    "the most recent actions the robot has executed. "
    "The past keyframes are selected frames of particular importance from all the actions the robot has executed "
    "so far. Based on these, output the current subtask the robot should execute and nothing else. "
    "Some tasks may have a video input for initial setup, some may not.\n\n"
    "Return a JSON with:\n"
    "- current_subtask: the action that should be executed at the current timestep\n"
    "- keyframe_positions: list of frame positions (1-indexed) from the current input images where actions change"
)
DEMO_QUERY = ("The task goal is '{task_goal}'. Given this pre-recorded video, please analyze the video and "
              "summarize the robot's actions in the video as a sequential list of subgoals, then predict the "
              "first subgoal")
IMAGE_QUERY = ("The task goal is '{task_goal}'. Given this first input image, please decompose the task goal "
               "into a sequence of subgoals and then predict the first subgoal")
VIDEO_QUERY = ("Given current new video clip of the robot execution, please describe what the robot has done in "
               "the video, then predict the next subgoal")

# Fourteen-joint robot: sign flips and gripper ranges.
JOINT_FLIPS = [1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1]
GRIPPER_DIMS = [6, 13]
GRIPPER_LINEAR = (0.01844, 0.05800)
GRIPPER_ANGULAR = (0.5476, 1.6296)
GRIPPER_JOINT = (-0.6213, 1.4910)
GRIPPER_ARM, GRIPPER_HORN = 0.036, 0.022

# Finite scalar quantization: bins per dimension by codebook size.
FSQ_BINS = {256: (8, 6, 5), 1024: (8, 5, 5, 5), 4096: (7, 5, 5, 5, 5), 16384: (8, 8, 8, 6, 5), 65536: (8, 8, 8, 5, 5, 5)}


# Fixed hold rules by task: how many counts an answer is held at least, by a text that it contains ("": any).
HOLD_RULES = {
    "ButtonUnmask": [("", 90)],
    "PickHighlight": [("", 90)],
    "ButtonUnmaskSwap": [("press the first button", 100), ("press the second button", 250)],
}

# Fixed texts of chat records.
VIDEO_MARK = "<video>"
GOAL_LEAD = "The task goal is: "
FIRST_TURN = "This is the initial turn for prediction\n"
HISTORY_LEAD = "The history of previous predicted {kind}s are: "
NEXT_QUESTION = "<image>What's the next {kind} based on current observation?"
SETUP_VIDEO = "The task has a video input for initial setup: <video>\n"
KEYFRAMES_LEAD = "\nHere are the selected frames from the entirety of the full execution that are of particular importance:"
CURRENT_LEAD = "\nHere is current input image list from the front-view camera: "
KEYFRAME_QUESTION = "\n\nWhat subtask should the robot execute and what is the keyframe position?"
ANSWER_WITH_KEYFRAME = ('{"current_subtask": "', '", "keyframe_positions": [', "]}")
ANSWER_WITHOUT_KEYFRAME = ('{"current_subtask":"', '", "keyframe_positions": []}')
