"""The default dictionary of listed companies and of words that look like one."""

from __future__ import annotations

from tidemark.functions.aliases import Entry

# What share buttons and hints at apps say; it is taken out before symbols are looked for.
NOISE = ["카카오톡", "카카오스토리", "카카오채널", "네이버 블로그", "네이버블로그", "네이버 밴드", "네이버밴드", "네이버 뉴스", "네이버 메인", "구글 플레이", "애플 앱스토어", "구글플레이"]

# Symbol, name, market, sector, aliases. Names of groups are no aliases, since they stand for many companies.
COMPANIES = """
005930 | 삼성전자 | KR | 반도체 | 삼성전자, 삼성전자우
000660 | SK하이닉스 | KR | 반도체 | SK하이닉스, 하이닉스
373220 | LG에너지솔루션 | KR | 2차전지 | LG에너지솔루션, 엘지에너지솔루션, LG엔솔
207940 | 삼성바이오로직스 | KR | 바이오 | 삼성바이오로직스, 삼바
005380 | 현대차 | KR | 자동차 | 현대차, 현대자동차
000270 | 기아 | KR | 자동차 | 기아자동차, 기아차
005490 | POSCO홀딩스 | KR | 철강 | POSCO홀딩스, 포스코홀딩스, 포스코
051910 | LG화학 | KR | 화학 | LG화학, 엘지화학
006400 | 삼성SDI | KR | 2차전지 | 삼성SDI
035420 | NAVER | KR | 인터넷 | 네이버, NAVER
035720 | 카카오 | KR | 인터넷 | 카카오
323410 | 카카오뱅크 | KR | 은행 | 카카오뱅크
377300 | 카카오페이 | KR | 핀테크 | 카카오페이
105560 | KB금융 | KR | 은행 | KB금융, 국민은행, KB국민은행
055550 | 신한지주 | KR | 은행 | 신한지주, 신한금융, 신한은행
086790 | 하나금융지주 | KR | 은행 | 하나금융지주, 하나금융, 하나은행
316140 | 우리금융지주 | KR | 은행 | 우리금융지주, 우리금융, 우리은행
138040 | 메리츠금융지주 | KR | 증권 | 메리츠금융지주, 메리츠금융
012450 | 한화에어로스페이스 | KR | 방산 | 한화에어로스페이스, 한화에어로
047810 | 한국항공우주 | KR | 방산 | 한국항공우주, KAI
064350 | 현대로템 | KR | 방산 | 현대로템
042660 | 한화오션 | KR | 조선 | 한화오션, 대우조선해양
329180 | HD현대중공업 | KR | 조선 | HD현대중공업, 현대중공업
010140 | 삼성중공업 | KR | 조선 | 삼성중공업
009540 | HD한국조선해양 | KR | 조선 | HD한국조선해양, 한국조선해양
015760 | 한국전력 | KR | 유틸리티 | 한국전력, 한전
034020 | 두산에너빌리티 | KR | 발전설비 | 두산에너빌리티, 두산중공업
241560 | 두산밥캣 | KR | 기계 | 두산밥캣
000880 | 한화 | KR | 지주 | 한화솔루션, 한화시스템
010130 | 고려아연 | KR | 비철금속 | 고려아연
011200 | HMM | KR | 해운 | HMM
003490 | 대한항공 | KR | 항공 | 대한항공
032640 | LG유플러스 | KR | 통신 | LG유플러스, 엘지유플러스
017670 | SK텔레콤 | KR | 통신 | SK텔레콤, SKT
030200 | KT | KR | 통신 | KT주식회사
066570 | LG전자 | KR | 가전 | LG전자, 엘지전자
009150 | 삼성전기 | KR | 전자부품 | 삼성전기
011070 | LG이노텍 | KR | 전자부품 | LG이노텍
034730 | SK | KR | 지주 | SK이노베이션, SK온
096770 | SK이노베이션 | KR | 정유 | SK이노베이션
010950 | S-Oil | KR | 정유 | 에쓰오일, S-Oil, 에스오일
051900 | LG생활건강 | KR | 소비재 | LG생활건강
090430 | 아모레퍼시픽 | KR | 화장품 | 아모레퍼시픽, 아모레
097950 | CJ제일제당 | KR | 음식료 | CJ제일제당
271560 | 오리온 | KR | 음식료 | 오리온
282330 | BGF리테일 | KR | 유통 | BGF리테일, CU편의점
069960 | 현대백화점 | KR | 유통 | 현대백화점
004170 | 신세계 | KR | 유통 | 신세계백화점
139480 | 이마트 | KR | 유통 | 이마트
068270 | 셀트리온 | KR | 바이오 | 셀트리온
128940 | 한미약품 | KR | 제약 | 한미약품
000100 | 유한양행 | KR | 제약 | 유한양행
326030 | SK바이오팜 | KR | 바이오 | SK바이오팜
196170 | 알테오젠 | KR | 바이오 | 알테오젠
247540 | 에코프로비엠 | KR | 2차전지 | 에코프로비엠
086520 | 에코프로 | KR | 2차전지 | 에코프로
066970 | 엘앤에프 | KR | 2차전지 | 엘앤에프
003670 | 포스코퓨처엠 | KR | 2차전지 | 포스코퓨처엠
042700 | 한미반도체 | KR | 반도체장비 | 한미반도체
000990 | DB하이텍 | KR | 반도체 | DB하이텍
403870 | HPSP | KR | 반도체장비 | HPSP
058470 | 리노공업 | KR | 반도체장비 | 리노공업
112040 | 위메이드 | KR | 게임 | 위메이드
036570 | 엔씨소프트 | KR | 게임 | 엔씨소프트, NC소프트
251270 | 넷마블 | KR | 게임 | 넷마블
259960 | 크래프톤 | KR | 게임 | 크래프톤
352820 | 하이브 | KR | 엔터 | 하이브, HYBE
041510 | 에스엠 | KR | 엔터 | 에스엠엔터테인먼트, SM엔터테인먼트
122870 | 와이지엔터테인먼트 | KR | 엔터 | 와이지엔터테인먼트, YG엔터테인먼트
035900 | JYP Ent. | KR | 엔터 | JYP엔터테인먼트
018260 | 삼성에스디에스 | KR | IT서비스 | 삼성에스디에스, 삼성SDS
267250 | HD현대 | KR | 지주 | HD현대
012330 | 현대모비스 | KR | 자동차부품 | 현대모비스
161390 | 한국타이어앤테크놀로지 | KR | 자동차부품 | 한국타이어
028260 | 삼성물산 | KR | 건설 | 삼성물산
000720 | 현대건설 | KR | 건설 | 현대건설
006360 | GS건설 | KR | 건설 | GS건설
047050 | 포스코인터내셔널 | KR | 상사 | 포스코인터내셔널
078930 | GS | KR | 지주 | GS칼텍스
016360 | 삼성증권 | KR | 증권 | 삼성증권
005940 | NH투자증권 | KR | 증권 | NH투자증권
006800 | 미래에셋증권 | KR | 증권 | 미래에셋증권
071050 | 한국금융지주 | KR | 증권 | 한국금융지주, 한국투자증권
032830 | 삼성생명 | KR | 보험 | 삼성생명
000810 | 삼성화재 | KR | 보험 | 삼성화재
079550 | LIG넥스원 | KR | 방산 | LIG넥스원
272210 | 한화시스템 | KR | 방산 | 한화시스템
298040 | 효성중공업 | KR | 전력기기 | 효성중공업
010120 | LS ELECTRIC | KR | 전력기기 | LS일렉트릭, LS ELECTRIC
267260 | HD현대일렉트릭 | KR | 전력기기 | HD현대일렉트릭, 현대일렉트릭
NVDA | NVIDIA | US | 반도체 | 엔비디아, NVIDIA, NVDA
AAPL | Apple | US | IT하드웨어 | 애플, Apple, AAPL
MSFT | Microsoft | US | 소프트웨어 | 마이크로소프트, Microsoft, MSFT
GOOGL | Alphabet | US | 인터넷 | 알파벳, 구글, Alphabet, GOOGL
AMZN | Amazon | US | 유통 | 아마존, Amazon, AMZN
META | Meta Platforms | US | 인터넷 | 메타플랫폼스, Meta Platforms, META
TSLA | Tesla | US | 자동차 | 테슬라, Tesla, TSLA
AVGO | Broadcom | US | 반도체 | 브로드컴, Broadcom, AVGO
AMD | AMD | US | 반도체 | AMD
INTC | Intel | US | 반도체 | 인텔, Intel, INTC
MU | Micron | US | 반도체 | 마이크론, Micron
TSM | TSMC | US | 반도체 | TSMC, 타이완반도체
ASML | ASML | US | 반도체장비 | ASML
QCOM | Qualcomm | US | 반도체 | 퀄컴, Qualcomm, QCOM
ARM | Arm Holdings | US | 반도체 | Arm Holdings, ARM홀딩스
JPM | JPMorgan Chase | US | 은행 | JP모건, JPMorgan, JPM
GS | Goldman Sachs | US | 증권 | 골드만삭스, Goldman Sachs
BRK.B | Berkshire Hathaway | US | 복합 | 버크셔해서웨이, Berkshire
LLY | Eli Lilly | US | 제약 | 일라이릴리, Eli Lilly
NVO | Novo Nordisk | US | 제약 | 노보노디스크, Novo Nordisk
JNJ | Johnson & Johnson | US | 제약 | 존슨앤드존슨, Johnson & Johnson
XOM | Exxon Mobil | US | 에너지 | 엑슨모빌, Exxon
BA | Boeing | US | 항공우주 | 보잉, Boeing
NFLX | Netflix | US | 미디어 | 넷플릭스, Netflix, NFLX
ORCL | Oracle | US | 소프트웨어 | 오라클, Oracle, ORCL
PLTR | Palantir | US | 소프트웨어 | 팔란티어, Palantir, PLTR
COIN | Coinbase | US | 핀테크 | 코인베이스, Coinbase
UBER | Uber | US | 플랫폼 | 우버, Uber
DIS | Walt Disney | US | 미디어 | 디즈니, Disney
WMT | Walmart | US | 유통 | 월마트, Walmart
"""


def companies() -> list[Entry]:
    """The dictionary's lines, in order."""
    lines = [[part.strip() for part in line.split(" | ")] for line in COMPANIES.strip().split("\n")]
    return [Entry(*line[:4], tuple(alias.strip() for alias in line[4].split(","))) for line in lines]
