"""Chat templates: a table of layouts, and their compilation to columns over message arrays.

In a layout, ``<C>`` is the message, ``<N>`` the round, ``<BOS>`` and ``<EOS>`` the tokenizer's own tokens. Literals are folded
when the plan is built; message text is only ever concatenated, so text that looks like a placeholder stays as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    user: str = "<C>"
    assistant: str | None = None  #: default: the message, and the end token unless ends are efficient
    system: str = "<C>"
    observation: str | None = None  #: default: as user
    function: str | None = None  #: default: as assistant's default
    prefix: str = ""
    default_system: str = ""
    stop: tuple[str, ...] = ()
    efficient_eos: bool = False
    fused_system: bool = False  #: the system text goes into the first user message
    tools: str = "default"
    media: str = "base"
    replace_eos: bool = False

    def layout(self, role: str) -> str:
        own = "<C>" if self.efficient_eos else "<C><EOS>"
        return {
            "user": self.user, "assistant": own if self.assistant is None else self.assistant, "system": self.system,
            "observation": self.user if self.observation is None else self.observation, "function": own if self.function is None else self.function,
        }[role]


_REGISTRY: dict[str, Template] = {}


def register(template: Template) -> Template:
    if template.name in _REGISTRY:
        raise ValueError(f"template {template.name} exists")
    _REGISTRY[template.name] = template
    return template


def get(name: str) -> Template:
    if name not in _REGISTRY:
        raise ValueError(f"template {name} does not exist")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


# --- Families of layouts ------------------------------------------------------------------------------------------


def _marked(name: str, begin="<|im_start|>", mid="\n", end="<|im_end|>", gap="\n", ask="user", answer="assistant", **more) -> Template:
    """Turns of a role mark, the message and an end mark; the answer's mark closes the user's turn."""
    def turn(role):
        return f"{begin}{role}{mid}<C>{end}{gap}"

    reply = f"{begin}{answer}{mid}"
    layout = {"user": turn(ask) + reply, "assistant": f"<C>{end}{gap}", "system": turn("system")}
    if tool := more.pop("tool_role", None):
        layout["observation"] = turn(tool) + reply
    if more.pop("tool_response", False):
        layout["observation"] = f"{begin}user\n<tool_response>\n<C>\n</tool_response>{end}\n{reply}"
        layout |= {"function": f"<C>{end}\n", "tools": "qwen"}
    return Template(name, **(layout | {"stop": (end,)} | more))


def _headed(name: str, open_="<|start_header_id|>", close="<|end_header_id|>", end="<|eot_id|>", **more) -> Template:
    """Turns of a header between two marks, a blank line, the message and an end mark."""
    def turn(role):
        return f"{open_}{role}{close}\n\n<C>{end}"

    reply = f"{open_}assistant{close}\n\n"
    layout = {
        "user": turn("user") + reply, "assistant": f"<C>{end}", "system": turn("system"), "function": f"<C>{end}", "observation": turn("ipython") + reply,
        "tools": "llama3", "prefix": "<BOS>", "stop": (end, end.replace("eot", "eom")),
    }
    return Template(name, **(layout | more))


def _bracketed(name: str, space: str = "", **more) -> Template:
    """[INST] turns with tool calls and results between marks of their own."""
    layout = {
        "user": f"[INST]{space}<C>[/INST]", "system": "<C>\n\n", "function": f"[TOOL_CALLS]{space}<C><EOS>", "tools": "mistral", "prefix": "<BOS>", "fused_system": True,
        "observation": f'[TOOL_RESULTS]{space}{{"content": <C>}}[/TOOL_RESULTS]',
    }
    if space:
        layout["assistant"] = " <C><EOS>"
    return Template(name, **(layout | more))


def _gemma(name: str, **more) -> Template:
    return _marked(name, "<start_of_turn>", end="<end_of_turn>", answer="model", tool_role="tool", prefix="<BOS>", fused_system=True, **({"system": "<C>\n\n"} | more))


def _tagged(name: str, **more) -> Template:
    """Role tags on lines of their own, without an end mark."""
    layout = {
        "user": "<|user|>\n<C><|assistant|>", "system": "<|system|>\n<C>", "observation": "<|observation|>\n<C><|assistant|>", "function": "<C>", "tools": "glm4",
        "stop": ("<|user|>", "<|observation|>"), "efficient_eos": True,
    }
    return Template(name, **(layout | more))


# --- Fixed values: default system messages ------------------------------------------------------------------------

_CURIOUS_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_CURIOUS_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_HELPFUL = "You are a helpful assistant."
_QWEN = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
_INTERN = (
    "You are an AI assistant whose name is InternLM (书生·浦语).\n"
    "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
    "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."
)
_DBRX = (
    "You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\n"
    "YOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\n"
    "You assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n"
    "(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. "
    "You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\n"
    "This is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. "
    "You should be responding appropriately and usually that means not mentioning this.\n"
    "YOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."
)
_CODER = (
    "You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. "
    "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"
)
_GEEX = "你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。"
_MARCO = (
    "你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.\n## 重要！！！！！\n"
    "当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。\n"
    "<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。\n"
)
_SKYWORK = (
    "You are Skywork-o1, a thinking model developed by Skywork AI, specializing in solving complex problems involving mathematics, coding, and logical reasoning through deep thought. "
    "When faced with a user's request, you first engage in a lengthy and in-depth thinking process to explore possible solutions to the problem. "
    "After completing your thoughts, you then provide a detailed explanation of the solution process in your response."
)
_XUANYUAN = "以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"
_YAYI = (
    "You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  "
    "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
_YI_VL = (
    "This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, "
    "and respond to the human's questions with informative, helpful, detailed and polite answers. "
    "这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"
)
_SAILOR = "You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed."
_TELECHAT = "你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"
_ALPACA = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
_GLM_PREFIX, _VICUNA = "[gMASK]<sop>", "USER: <C> ASSISTANT:"

# --- Fixed values: the layouts ------------------------------------------------------------------------------------

for _t in (
    Template("alpaca", "### Instruction:\n<C>\n\n### Response:\n", "<C><EOS>\n\n", default_system=_ALPACA),
    Template("aquila", "Human: <C>###Assistant:", "<C>###", "System: <C>###", default_system=_CURIOUS_HUMAN, stop=("</s>",)),
    Template("atom", "<BOS>Human: <C>\n<EOS><BOS>Assistant:", "<C>\n<EOS>"),
    Template("baichuan", "<reserved_102><C><reserved_103>", efficient_eos=True),
    Template("baichuan2", "<reserved_106><C><reserved_107>", efficient_eos=True),
    Template(
        "bailing", "<role>HUMAN</role><C><role>ASSISTANT</role>", system="<role>SYSTEM</role><C>", observation="<role>OBSERVATION</role><C><role>ASSISTANT</role>",
        stop=("<|endoftext|>",), efficient_eos=True,
    ),
    Template("belle", "Human: <C>\n\nBelle: ", "<C><EOS>\n\n", prefix="<BOS>"),
    Template("bluelm", "[|Human|]:<C>[|AI|]:"),
    Template("breeze", "[INST] <C> [/INST] ", prefix="<BOS>", efficient_eos=True),
    Template("chatglm2", "[Round <N>]\n\n问：<C>\n\n答：", prefix="[gMASK]sop", efficient_eos=True),
    _tagged("chatglm3", assistant="\n<C>", prefix="[gMASK]sop"),
    _marked("chatml", tool_role="tool", stop=("<|im_end|>", "<|im_start|>"), replace_eos=True),
    _marked("chatml_de", tool_role="tool", stop=("<|im_end|>", "<|im_start|>"), replace_eos=True, default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent."),
    Template("codegeex2", prefix="[gMASK]sop"),
    _tagged("codegeex4", user="<|user|>\n<C><|assistant|>\n", observation="<|observation|>\n<C><|assistant|>\n", prefix=_GLM_PREFIX, default_system=_GEEX),
    Template(
        "cohere", "<|START_OF_TURN_TOKEN|><|USER_TOKEN|><C><|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>",
        system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|><C><|END_OF_TURN_TOKEN|>", prefix="<BOS>",
    ),
    Template("cpm", "<用户><C><AI>", prefix="<BOS>"),
    _marked("cpm3", prefix="<BOS>"),
    _marked("dbrx", tool_role="tool", default_system=_DBRX),
    Template("deepseek", "User: <C>\n\nAssistant:", system="<C>\n\n", prefix="<BOS>"),
    Template("deepseek3", "<｜User｜><C><｜Assistant｜>", prefix="<BOS>"),
    Template("deepseekcoder", "### Instruction:\n<C>\n### Response:", "\n<C>\n<|EOT|>\n", prefix="<BOS>", default_system=_CODER),
    Template("default", "Human: <C><EOS>\nAssistant:", "<C><EOS>\n", "System: <C><EOS>\n"),
    Template("empty", assistant="<C>"),
    Template("exaone", "[|user|]<C>\n[|assistant|]", "<C><EOS>\n", "[|system|]<C>[|endofturn|]\n"),
    Template("falcon", "User: <C>\nFalcon:", "<C>\n", efficient_eos=True),
    Template("fewshot", assistant="<C>\n\n", efficient_eos=True),
    _gemma("gemma"),
    _gemma("gemma3", media="gemma3"),
    _tagged("glm4", assistant="\n<C>", prefix=_GLM_PREFIX),
    Template(
        "granite3", "<|start_of_role|>user<|end_of_role|><C><|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "<C><|end_of_text|>\n",
        "<|start_of_role|>system<|end_of_role|><C><|end_of_text|>\n",
    ),
    Template("index", "reserved_0<C>reserved_1", system="<unk><C>", efficient_eos=True),
    _marked("hunyuan", "<|bos|>", end="<|eos|>", prefix="<|bos|>"),
    Template("intern", "<|User|>:<C>\n<|Bot|>:", "<C><eoa>\n", "<|System|>:<C>\n", prefix="<BOS>", default_system=_INTERN, stop=("<eoa>",)),
    _marked("intern2", prefix="<BOS>", default_system=_INTERN),
    Template("llama2", "<BOS>[INST] <C> [/INST]", system="<<SYS>>\n<C>\n<</SYS>>\n\n", fused_system=True),
    Template("llama2_zh", "<BOS>[INST] <C> [/INST]", system="<<SYS>>\n<C>\n<</SYS>>\n\n", fused_system=True, default_system="You are a helpful assistant. 你是一个乐于助人的助手。"),
    _headed("llama3"),
    _headed("llama4", "<|header_start|>", "<|header_end|>", "<|eot|>", media="llama4"),
    _headed("mllama", media="mllama"),
    Template(
        "moonlight", "<|im_user|>user<|im_middle|><C><|im_end|><|im_assistant|>assistant<|im_middle|>", "<C><|im_end|>", "<|im_system|>system<|im_middle|><C><|im_end|>",
        default_system="You are a helpful assistant provided by Moonshot-AI.", stop=("<|im_end|>",),
    ),
    Template("llava", _VICUNA, default_system=_CURIOUS_USER, media="llava"),
    Template("llava_next", _VICUNA, default_system=_CURIOUS_USER, media="llava_next"),
    _headed("llava_next_llama3", media="llava_next"),
    _bracketed("llava_next_mistral", " ", media="llava_next"),
    _marked("llava_next_qwen", tool_response=True, default_system=_HELPFUL, media="llava_next"),
    _marked("llava_next_yi", media="llava_next"),
    Template("llava_next_video", _VICUNA, default_system=_CURIOUS_USER, media="llava_next_video"),
    _bracketed("llava_next_video_mistral", " ", media="llava_next_video"),
    _marked("llava_next_video_yi", media="llava_next_video"),
    _marked("marco", tool_role="tool", default_system=_MARCO),
    _marked("minicpm_v", default_system=_HELPFUL, media="minicpm_v"),
    _marked("minicpm_o", default_system=_QWEN, media="minicpm_v"),
    _bracketed("ministral"),
    _bracketed("mistral", " "),
    _bracketed("mistral_small", system="[SYSTEM_PROMPT]<C>[/SYSTEM_PROMPT]", fused_system=False),
    Template("olmo", "<|user|>\n<C><|assistant|>\n", prefix="<EOS>"),
    Template("openchat", "GPT4 Correct User: <C><EOS>GPT4 Correct Assistant:", prefix="<BOS>"),
    Template(
        "openchat-3.6", "<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n<C><|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n",
        prefix="<BOS>", stop=("<|eot_id|>",),
    ),
    _marked("opencoder", tool_role="tool", default_system="You are OpenCoder, created by OpenCoder Team."),
    Template("orion", "Human: <C>\n\nAssistant: <EOS>", prefix="<BOS>"),
    Template("paligemma", "<C>\n", prefix="<BOS>", fused_system=True, media="paligemma"),
    _gemma("paligemma_chat", system="<C>", media="paligemma"),
    Template("phi", "<|user|>\n<C><|end|>\n<|assistant|>\n", "<C><|end|>\n", "<|system|>\n<C><|end|>\n", stop=("<|end|>",)),
    Template("phi_small", "<|user|>\n<C><|end|>\n<|assistant|>\n", "<C><|end|>\n", "<|system|>\n<C><|end|>\n", stop=("<|end|>",)),
    _marked("phi4", mid="<|im_sep|>", gap=""),
    _bracketed("pixtral", media="pixtral"),
    _marked("qwen", tool_response=True, default_system=_QWEN),
    _marked("qwen2_audio", default_system=_HELPFUL, media="qwen2_audio"),
    _marked("qwen2_omni", tool_response=True, default_system=_HELPFUL, media="qwen2_omni"),
    _marked("qwen2_vl", tool_response=True, default_system=_HELPFUL, media="qwen2_vl"),
    _marked("sailor", ask="question", answer="answer", default_system=_SAILOR),
    _headed("skywork_o1", default_system=_SKYWORK),
    Template("solar", "### User:\n<C>\n\n### Assistant:\n", system="### System:\n<C>\n\n", efficient_eos=True),
    Template("starchat", "<|user|>\n<C><|end|>\n<|assistant|>", "<C><|end|>\n", "<|system|>\n<C><|end|>\n", stop=("<|end|>",)),
    Template("telechat", "<_user><C><_bot>", system="<_system><C><_end>"),
    Template("telechat2", "<_user><C><_bot>", system="<_system><C>", default_system=_TELECHAT),
    Template("vicuna", _VICUNA, default_system=_CURIOUS_USER),
    Template("video_llava", _VICUNA, default_system=_CURIOUS_USER, media="video_llava"),
    Template("xuanyuan", "Human: <C> Assistant:", default_system=_XUANYUAN),
    Template("xverse", "Human: <C>\n\nAssistant: "),
    Template("yayi", "<|Human|>:\n<C>\n\n<|YaYi|>:", "<C>\n\n", "<|System|>:\n<C>\n\n", default_system=_YAYI, stop=("<|End|>",)),
    _marked("yi"),
    Template("yi_vl", "### Human: <C>\n### Assistant:", "<C>\n", default_system=_YI_VL, stop=("###",), efficient_eos=True, media="llava"),
    Template("yuan", "<C><sep>", "<C><eod>\n", stop=("<eod>",)),
    Template("zephyr", "<|user|>\n<C><EOS><|assistant|>\n", system="<|system|>\n<C><EOS>", default_system="You are Zephyr, a helpful assistant."),
    Template("ziya", "<human>:<C>\n<bot>:", "<C>\n"),
):
    register(_t)


# --- Compilation --------------------------------------------------------------------------------------------------


def filled(layout: str, content: Column, bos: str = "", eos: str = "", turn: Column | None = None) -> Column:
    """A layout as one concatenation of literals and the message."""
    parts = []
    for piece in re.split(r"(<C>|<N>|<BOS>|<EOS>)", layout):
        if piece == "<C>":
            parts.append(content)
        elif piece == "<N>":
            parts.append(turn.cast("string") if turn is not None else F.lit("0"))
        elif text := {"<BOS>": bos, "<EOS>": eos}.get(piece, piece):
            parts.append(F.lit(text))
    return F.concat(*parts) if parts else F.lit("")


def turns(template: Template, messages: Column, system: Column | None = None, tools: Column | None = None, bos: str = "", eos: str = "") -> Column:
    """The text of each message as array<string>; ``tools`` is the text of the tool prompt. An unknown role raises."""
    given = F.coalesce(system, F.lit("")) if system is not None else F.lit("")
    text = F.when(given == "", F.lit(template.default_system)).otherwise(given)
    tool_text = F.coalesce(tools, F.lit("")) if tools is not None else F.lit("")
    whole = F.concat(text, tool_text)
    head = F.when(whole != "", filled(template.system, whole, bos, eos)).otherwise(F.lit(""))
    prefix = filled(template.prefix, F.lit(""), bos, eos) if template.prefix else F.lit("")

    def one(message: Column, i: Column) -> Column:
        content = message["content"]
        asked = F.when(i == 0, F.concat(head, content)).otherwise(content) if template.fused_system else content
        turn = F.floor(i / 2)
        body = F.when(message["role"] == "user", filled(template.user, asked, bos, eos, turn))
        for role in ("assistant", "observation", "function"):
            body = body.when(message["role"] == role, filled(template.layout(role), content, bos, eos, turn))
        body = body.otherwise(F.raise_error(F.concat(F.lit("unexpected role: "), F.coalesce(message["role"], F.lit("null")))))
        front = prefix if template.fused_system else F.concat(prefix, head)
        return F.when(i == 0, F.concat(front, body)).otherwise(body)

    return F.transform(messages, one)


def one_turn(rendered: Column) -> tuple[Column, Column]:
    """(prompt, response): everything before the last message, and it."""
    n = F.size(rendered)
    return F.array_join(F.slice(rendered, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.element_at(rendered, -1)


def pairs(rendered: Column) -> Column:
    """array<struct<source, target>> of the rounds."""
    n = (F.size(rendered) / 2).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(rendered, i * 2).alias("source"), F.get(rendered, i * 2 + 1).alias("target")))
    return F.when(n > 0, each).otherwise(F.slice(each, 1, 0))


def stop_words(template: Template, eos: str) -> tuple[str, list[str]]:
    """(end token, further stop words) after the template's own end token has replaced the tokenizer's."""
    if template.replace_eos:
        if not template.stop:
            raise ValueError("stop words are needed to replace the end token")
        return template.stop[0], list(template.stop[1:])
    return eos or "<|endoftext|>", list(template.stop)


def with_name(template: Template, name: str, **changes) -> Template:
    return register(replace(template, name=name, **changes))


def modelfile(template: Template, location: str = ".", eos: str = "") -> str:
    """A model description file for a local runner."""
    put = lambda layout, slot: layout.replace("<C>", "{{ " + slot + " }}").replace("<BOS>", "").replace("<EOS>", eos)
    body = template.prefix.replace("<BOS>", "").replace("<EOS>", eos) + "{{ if .System }}" + put(template.system, ".System") + "{{ end }}"
    body += '{{ range .Messages }}{{ if eq .Role "user" }}' + put(template.user, ".Content") + '{{ else if eq .Role "assistant" }}' + put(template.layout("assistant"), ".Content") + "{{ end }}{{ end }}"
    lines = [f"FROM {location}", "", f'TEMPLATE """{body}"""', ""]
    if template.default_system:
        lines += [f'SYSTEM """{template.default_system}"""', ""]
    return "\n".join(lines + [f'PARAMETER stop "{w}"' for w in template.stop] + ["PARAMETER num_ctx 4096"]) + "\n"


def jinja(template: Template, bos: str = "", eos: str = "") -> str:
    """The layout as a Jinja chat template."""
    def slot(layout: str, name: str) -> str:
        parts = [p for p in re.split(r"(<C>|<BOS>|<EOS>)", layout) if p]
        shown = [name if p == "<C>" else repr({"<BOS>": bos, "<EOS>": eos}.get(p, p)) for p in parts if {"<BOS>": bos, "<EOS>": eos}.get(p, p)]
        return "{{ " + (" + ".join(shown) or "''") + " }}"

    head = f"{{% set system_message = {template.default_system!r} %}}" if template.default_system else ""
    loop = (
        "{% if messages[0]['role'] == 'system' %}{% set system_message = messages[0]['content'] %}{% set loop_messages = messages[1:] %}"
        "{% else %}{% set loop_messages = messages %}{% endif %}"
    )
    first = "" if template.fused_system else "{% if system_message is defined %}" + slot(template.system, "system_message") + "{% endif %}"
    content = "{% set content = message['content'] %}"
    if template.fused_system:
        inner = slot(template.system, "system_message")[3:-3]
        content = f"{{% set content = ({inner} + message['content']) if loop.index0 == 0 and system_message is defined else message['content'] %}}"
    body = "{% if message['role'] == 'user' %}" + slot(template.user, "content") + "{% elif message['role'] == 'assistant' %}" + slot(template.layout("assistant"), "content") + "{% endif %}"
    return (slot(template.prefix, "''") if template.prefix else "") + head + loop + first + "{% for message in loop_messages %}" + content + body + "{% endfor %}"
