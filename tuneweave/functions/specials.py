"""Fixed values shared by the tokenizer, the chat template and the label rules.

FIXED VALUES (must stay as written for results to line up with the
instruction-tuning data conventions this library reproduces):

* ignored label id: -100
* padding id of the reference's default tokenizer: 151643
* chat markers: "<|im_start|>", "<|im_end|>", end of text "<|endoftext|>"
* conversation roles understood by the SFT template: "user", "assistant"
* default system message: "You are a helpful assistant."
* prompt template pieces: " Human: ", " Assistant:", " Assistant: "
* PPO constants: kl coefficient 0.1, reward clip 5, gamma 1.0, lambda 0.95,
  policy clip 0.2, value clip 0.2
* whitespace word split pattern: [ \\t\\n\\r\\f]+

The whitespace vocabulary tokenizer of this library reserves ids 0..4 for
special tokens and numbers words from 5 on, most frequent first.
"""

IGNORE_INDEX = -100
REFERENCE_PAD_ID = 151643

ENDOFTEXT = "<|endoftext|>"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
NEWLINE = "\n"
UNK = "<|unk|>"

# ids of the built-in whitespace vocabulary tokenizer
SPECIAL_IDS = {ENDOFTEXT: 0, IM_START: 1, IM_END: 2, NEWLINE: 3, UNK: 4}
PAD_ID = SPECIAL_IDS[ENDOFTEXT]
UNK_ID = SPECIAL_IDS[UNK]
FIRST_WORD_ID = 5

# specials that may appear inside text and are cut out before splitting
INLINE_SPECIALS = (ENDOFTEXT, IM_START, IM_END, UNK)

WORD_SPLIT = r"[ \t\n\r\f]+"

SFT_ROLES = ("user", "assistant")
DEFAULT_SYSTEM_MESSAGE = "You are a helpful assistant."

HUMAN_PREFIX = " Human: "
ASSISTANT_SUFFIX = " Assistant:"
ASSISTANT_JOIN = " Assistant: "

KL_CTL = 0.1
CLIP_REWARD_VALUE = 5.0
GAMMA = 1.0
LAM = 0.95
CLIP_RANGE = 0.2
CLIP_RANGE_VALUE = 0.2
