"""Vocabulary profiles: layered word lists and patterns, compiled into one pattern at planning time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace


def distinct(items: Iterable[str]) -> tuple[str, ...]:
    """Each once, in order; blanks go."""
    return tuple(dict.fromkeys(x for x in items if x and x.strip()))


@dataclass(frozen=True)
class Profile:
    """What rules know of a language and an account. Patterns are Java regular expressions."""

    script: str  # character class of the expected script
    hard: tuple[str, ...] = ()
    hard_patterns: tuple[str, ...] = ()
    review: tuple[str, ...] = ()
    review_patterns: tuple[str, ...] = ()
    dangling_end: str = r"(?!x)x"
    dependent_start: str = r"(?!x)x"
    leading_reference: str = r"(?!x)x"
    chatter: str = r"(?!x)x"
    malformed: str = r"(?!x)x"
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    least_share: float = 0.5

    def _pattern(self, words: tuple[str, ...], patterns: tuple[str, ...]) -> str:
        parts = [*(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", w) for w in words), *(f"(?:{p})" for p in patterns)]
        return "(?i)(?:" + "|".join(parts) + ")" if parts else r"(?!x)x"

    @property
    def hard_pattern(self) -> str:
        return self._pattern(self.hard, self.hard_patterns)

    @property
    def review_pattern(self) -> str:
        return self._pattern(self.review, self.review_patterns)

    def layered(self, changes: dict[str, list[str]]) -> Profile:
        """This profile with a layer's `hard_add`, `hard_remove`, `review_add`, `review_remove` and their `_regex_` kinds.

        Removal is from what stands below, addition comes after it; what is hard is not for review.
        """

        def merged(base: tuple[str, ...], kind: str) -> tuple[str, ...]:
            gone = set(changes.get(f"{kind}_remove") or ())
            return distinct([*(x for x in base if x not in gone), *(changes.get(f"{kind}_add") or ())])

        hard = merged(self.hard, "hard")
        return replace(
            self, hard=hard, review=tuple(x for x in merged(self.review, "review") if x not in hard),
            hard_patterns=merged(self.hard_patterns, "hard_regex"), review_patterns=merged(self.review_patterns, "review_regex"),
        )


def read_layer(path: str | None) -> dict[str, list[str]]:
    """SRC14: a layer from a JSON file; none, missing and unreadable files are empty layers."""
    try:
        with open(path or "", encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    return {k: [str(x) for x in v] for k, v in data.items() if isinstance(v, list)} if isinstance(data, dict) else {}


def merge_layers(current: dict[str, list[str]], patch: dict[str, list[str]]) -> dict[str, list[str]]:
    """Additions of both less removals of both; removal wins. Sorted."""
    out = {}
    for kind in ("hard", "review"):
        gone = {*current.get(f"{kind}_remove", ()), *patch.get(f"{kind}_remove", ())}
        out[f"{kind}_remove"] = sorted(gone)
        out[f"{kind}_add"] = sorted(({*current.get(f"{kind}_add", ())} | {*patch.get(f"{kind}_add", ())}) - gone)
    return out


#: Words and patterns of the Chinese shopping profile that results depend on (fixed values).
CHINESE = Profile(
    script=r"㐀-䶿一-鿿",
    hard=("上链接", "放链接", "开链接", "挂链接", "一号链接", "链接上车", "小黄车", "上车", "链接", "宝子们拍", "点击下方", "左下方", "直播间", "开播", "下播", "直播", "场控", "卖出去", "卖爆", "卖空", "售罄", "爆单", "卖了多少单", "快拍", "拍它", "拍一单", "加单", "上单", "单量", "秒杀", "抢购", "售价", "专柜价", "专柜售价", "原价", "划线价", "标价", "报价"),
    hard_patterns=(r"\d+\s*单", r"[一二三四五六七八九十百千]+\s*单", r"\d{1,3}(?:,\d{3})+", r"小香(?!风)"),
    review=("下单", "拍下", "发货", "现货", "库存", "快飞", "价格", "到手价", "优惠价", "福利价", "打折", "折扣", "降价", "多少钱", "限量", "专柜"),
    review_patterns=(r"多少\s*钱", r"多钱", r"几\s*折"),
    dangling_end=r"(?:因为|所以|但是|而且|然后|如果|虽然|不过|并且|以及|或者|要是|只要|除非|比如|包括|接着)$",
    dependent_start=r"^(?:的(?!确)|然后|所以|但是|不过|而且|还有|因为|其实这个|这个的话|它的话|那这个|这(?:条|套|双)(?:的话)?|穿上以后|腰部这里|它整个就是|你看这个)",
    leading_reference=r"^(?:(?:这|那)(?:个|种|样|条|套|双|件|款)|这些|那些|它|它们|穿上以后|腰部这里|它整个就是|你看这个)",
    chatter=r"(?:删掉|先删|再拍(?:一个|一下)|稍等(?:一下)?|给我拿|拿出来|帮我置顶|后台|催单|挂一个|上链接|报一下|还有多少(?:件|条|双)|48小时(?:可以)?飞|发货|物流|运费险|给我打个有|全没了|不够卖|预售|自己去看评价)",
    malformed=r"(?:羊毛手手|一定要把我告诉你|想给你做出这么漂(?:啊|呀|哎|哦|$)|你很糟糕[，, ]*你好着急)",
)

#: Misheard terms and what they stand for (fixed values).
CHINESE_TERMS = [
    (r"大底(?=[Tt]恤)", "大版"), (r"一件提取", "一件起批"), (r"裸口", "罗纹"), (r"弹粒", "弹力"), (r"安伦", "氨纶"), (r"背信", "背心"), (r"长蹄", "长T"), (r"俄容", "鹅绒"),
    (r"秀底", "袖底"), (r"航风", "行缝"), (r"先货", "现货"), (r"搭半球", "搭半裙"), (r"渣感", "扎感"), (r"桑残丝", "桑蚕丝"), (r"打体衫", "打底衫"), (r"出篇", "出片"),
]

#: A profile for Latin scripts, as the tables at hand have no Han text.
LATIN = Profile(
    script="A-Za-zÀ-ÿ",
    hard=("license", "haha", "enen"),
    hard_patterns=(r"\d+\s*eur", r"password"),
    review=("the", "des", "und", "que"),
    review_patterns=(r"\d{3}-\d{4}",),
    dangling_end=r"(?:\b(?:and|but|because|if|or|of|the|et|de|que|la|und|der|y))$",
    dependent_start=r"^(?:and|but|so|because|of|et|de|und|que|y)\b",
    leading_reference=r"^(?:this|that|these|those|it|elle|die|das)\b",
    chatter=r"(?:shth|ouoi|ndnd)",
    malformed=r"(?:thth|èè)",
    categories={
        "hook": ("and", "une"), "result": ("ing", "tion"), "pain": ("not", "pas"), "material": ("ness", "ment"), "color": ("en", "eau"),
        "fit": ("ly", "eux"), "scene": ("in", "dans"), "proof": ("ble", "que"), "close": ("est", "der"),
    },
    least_share=0.6,
)
